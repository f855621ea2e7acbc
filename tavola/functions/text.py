"""Text expressions: token rule, stop words, n-grams.

Token rule: lower-case, maximal runs of two or more letters, digits or
underscores (the ``\\b\\w\\w+\\b`` rule of common TF-IDF tokenizers, written
with Unicode classes so Spark (Java regex) and the SQL oracle (RE2) agree).
Stop words: Spark ML's built-in English list, pinned below so that the
DataFrame job and the SQL oracle share one list and no file is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


# Spark ML's default English stop words, in their order.
STOP_WORDS = tuple("""
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is
    are was were be been being have has had having do does did doing a an the and but if or because as until
    while of at by for with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now
    i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
    they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
    won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
    there's what's when's where's who's why's would
""".split())


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(text) -> Column:
    """Lower-cased tokens of a text column, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def analyze(df: DataFrame, text: str, out: str = "terms", ngram_max: int = 2) -> DataFrame:
    """Add ``out``: unigrams (+ bigrams) after stop-word removal, built with
    Spark ML's tokenizer, stop-word remover and n-gram transformers.

    Each step reads the previous column once per row (hash-set stop-word
    lookup in the JVM), which keeps long documents linear in their length."""
    from pyspark.ml.feature import NGram, RegexTokenizer, StopWordsRemover
    base = df.withColumn("_txt", F.coalesce(F.col(text), F.lit("")))
    tok = RegexTokenizer(inputCol="_txt", outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False,
                         toLowercase=True, minTokenLength=2)
    sw = StopWordsRemover(inputCol="_tok", outputCol="_uni", stopWords=list(STOP_WORDS),
                          caseSensitive=True)
    res = sw.transform(tok.transform(base))
    if ngram_max >= 2:
        res = NGram(n=2, inputCol="_uni", outputCol="_bi").transform(res)
        res = res.withColumn(out, F.concat("_uni", "_bi")).drop("_bi")
    else:
        res = res.withColumn(out, F.col("_uni"))
    return res.drop("_txt", "_tok", "_uni")


def word_count(text) -> Column:
    """Whitespace-separated words (Python ``len(s.split())``)."""
    return F.size(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"\S+"), 0))


# SQL twins ------------------------------------------------------------------

def sql_stop_list() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"


def sql_filtered_tokens(text: str) -> str:
    """DuckDB list of tokens after stop-word removal, same rule as Spark."""
    toks = f"regexp_extract_all(lower(COALESCE({text}, '')), '{TOKEN_PATTERN}')"
    return f"list_filter({toks}, lambda x: NOT list_contains({sql_stop_list()}, x))"


def sql_terms_from(t: str) -> str:
    """DuckDB unigram + bigram list from a filtered token list column ``t``."""
    return (f"list_concat({t}, CASE WHEN len({t}) >= 2 THEN list_transform(range(1, len({t})), "
            f"lambda i: {t}[i] || ' ' || {t}[i + 1]) ELSE [] END)")
