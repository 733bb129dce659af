"""Column expressions over raw text: sentences, cleaning, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a sentence. It opens with a capital A-Z or a
# double quote, may hold inner punctuation that is not followed by white space,
# and ends at . ! ? (with an optional closing quote) or at the end of the text.
# The quantifiers are possessive: everything after them is optional, so giving
# characters back never finds another match, and the matcher then runs in
# constant stack. With plain greedy ones a text such as "A.b.b.b..." of a few
# thousand parts overflows the executor's stack and kills it.
SENTENCE_PATTERN = r"""[A-Z"][^.!?]*+(?:[.!?](?!['"]?\s|$)[^.!?]*+)*+[.!?]?['"]?"""

# White space as a Unicode-aware engine sees it, spelled out so
# that it does not depend on the regex dialect.
WHITE_SPACE = r"\x09-\x0d\x1c-\x20\x85\p{Z}"

# Masks for links and user names.
URL_PATTERN = rf"www\.[^{WHITE_SPACE}]+|https?://[^{WHITE_SPACE}]+"
USER_PATTERN = rf"@[^{WHITE_SPACE}]+"

# Joined words a Treebank-style tokenizer takes apart.
SPLIT_WORDS = ("can not", "gim me", "gon na", "got ta", "lem me", "wan na")

# English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours "
    "yourself yourselves he him his himself she she's her hers herself it it's its "
    "itself they them their theirs themselves what which who whom this that that'll "
    "these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why how all "
    "any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don don't should should've now d ll m o re ve y ain aren "
    "aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven "
    "haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't "
    "shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()


def sentence_array(text: Column) -> Column:
    """All sentences of a text, in order."""
    return F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0))


def shingle_count(sentence: Column, shingle_len: int) -> Column:
    """Number of length-``shingle_len`` character windows (may be <= 0)."""
    return F.length(sentence) - F.lit(shingle_len - 1)


def shingle_array(sentence: Column, shingle_len: int) -> Column:
    """Every character window of the sentence, left to right."""
    n = shingle_count(sentence, shingle_len)
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.substring(sentence, i, F.lit(shingle_len)),
    )
    return F.when(n > 0, windows).otherwise(F.array().cast("array<string>"))


def sentence_id(doc_id: Column, ord_: Column) -> Column:
    """``doc:ord`` identity string."""
    return F.concat_ws(":", doc_id.cast("string"), ord_.cast("string"))


def clean_text(text: Column) -> Column:
    """Mask links and users, keep ASCII letters only, lower-case.

    White-space collapsing, symbol removal, hashtag unwrapping and quote
    trimming all happen in the letters-only step: every character they touch
    becomes a separator there.
    """
    masked = F.regexp_replace(text, URL_PATTERN, "URL")
    masked = F.regexp_replace(masked, USER_PATTERN, "AT_USER")
    return F.lower(F.regexp_replace(masked, "[^a-zA-Z]+", " "))


def word_tokens(cleaned: Column) -> Column:
    """Words of a cleaned text, joined words taken apart, duplicates kept."""
    heads = [r"{}(?={}\b)".format(*words.split()) for words in SPLIT_WORDS]
    apart = F.regexp_replace(cleaned, rf"\b({'|'.join(heads)})", "$1 ")
    return F.filter(F.split(apart, " +"), lambda t: t != F.lit(""))


def drop_stop_words(tokens: Column) -> Column:
    """Tokens without stop words; order and duplicates kept."""
    return F.filter(tokens, lambda t: ~t.isin(STOP_WORDS))


def clean_tokens(text: Column) -> Column:
    return drop_stop_words(word_tokens(clean_text(text)))
