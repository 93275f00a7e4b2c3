"""Rule-based quality verdict by distribution divergence, in DataFrame functions only.

Besides plain counts (words, symbols, repeated lines and 8-word windows), every document gets two
histograms: its characters by class and its words by the common words of its language. Both are
compared with the reference of that language by Jensen-Shannon distance: the sum over all its
documents that don't fail the counts of their histograms in thousandths, so that long documents
count like others. Short texts have noisy histograms, so each comparison has a least length. The
references have one row per language of a fixed list and one for all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.scratch import written

# Frequent function words.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
}
#: Compared where a document's language is none of the above.
OTHER_WORDS = [w for words in COMMON_WORDS.values() for w in words[:3]]
OTHER = "other"

CHAR_CLASSES = ["lower", "upper", "digit", "symbol", "mark", "rest"]
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Least words for the comparison of characters and of words.
MIN_FOR_CHARS, MIN_FOR_WORDS = 40, 60
#: Greatest Jensen-Shannon distances (0 to 1) of a kept document. Some 83 % of a language's words
#: aren't common ones, so a text without common words is only about 0.3 away.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.25

_BLANKS = " \t\n\x0b\x0c\r"
_BLANK_RUN = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BLANK_RUN, -1))


def _list_of(lang: Column) -> Column:
    choice = F.lit(None).cast("array<string>")
    for name, words in COMMON_WORDS.items():
        choice = F.when(lang == name, F.array(*map(F.lit, words))).otherwise(choice)
    return F.coalesce(choice, F.array(*map(F.lit, OTHER_WORDS)))


def histograms(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add ``_words``, ``_lang``, ``_n``, ``_chars`` (counts by class) and ``_common`` (by common word, then the rest)."""
    df = df.withColumn("_words", words_of(F.col(text)))
    df = df.withColumn("_lang", F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang)).otherwise(F.lit(OTHER)))
    df = df.withColumns({"_n": F.size("_words").cast("long"), "_c0": F.array_join("_words", ""), "_list": _list_of(F.col("_lang"))})
    # Each class is taken out in turn, the most frequent first, so that every pass is over less text.
    patterns = ["[a-z]+", "[A-Z]+", "[0-9]+", "[#*$%&|<>]+", r"[.,;:!?'\"()\-]+"]
    for k, p in enumerate(patterns):
        df = df.withColumn(f"_c{k + 1}", F.regexp_replace(f"_c{k}", p, ""))
    left = [F.length(f"_c{k}").cast("long") for k in range(len(patterns) + 1)]
    counts = [a - b for a, b in zip(left, left[1:], strict=False)] + left[-1:]
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    forms = every + [w.capitalize() for w in every]
    df = df.withColumns({"_chars": F.array(*counts), "_word_chars": left[0], "_hits": F.filter("_words", lambda w: w.isin(forms))})
    # The list is in lower case; a hit counts for it in either form of its first letter.
    low = F.transform("_hits", F.lower)
    df = df.withColumn("_hits", low)
    found = F.transform("_list", lambda w: F.size(F.filter("_hits", lambda h: h == w)).cast("long"))
    df = df.withColumn("_found", found)
    rest = F.col("_n") - F.aggregate("_found", F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("_common", F.concat("_found", F.array(rest)))
    return df.drop(*[f"_c{k}" for k in range(len(patterns) + 1)], "_list", "_hits", "_found")


def references(h: DataFrame) -> DataFrame:
    """From :func:`histograms`, the reference histograms: at most one row for each known language and one more."""
    n = len(OTHER_WORDS) + 1

    def thousandths(counts: str, k: int) -> Column:
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.coalesce(F.sum(F.floor(1000 * F.get(counts, F.lit(k)) / F.nullif(total, F.lit(0)))), F.lit(0))

    sums = [thousandths("_chars", k).alias(f"c{k}") for k in range(len(CHAR_CLASSES))]
    sums += [thousandths("_common", k).alias(f"w{k}") for k in range(n)]
    by = h.groupBy("_lang").agg(*sums)
    return by.select(
        "_lang",
        F.array(*[f"c{k}" for k in range(len(CHAR_CLASSES))]).alias("_ref_chars"),
        F.array(*[f"w{k}" for k in range(n)]).alias("_ref_common"),
    )


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x).cast("double")


def js_distance(p: str, q: str) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of counts; 0 if either is empty."""
    tp, tq = _total(F.col(p)), _total(F.col(q))

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def both(a: Column, b: Column) -> Column:
        x, y = a.cast("double") / tp, b.cast("double") / tq
        return (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2

    total = F.aggregate(F.zip_with(p, q, both), F.lit(0.0), lambda a, x: a + x)
    return F.when((tp > 0) & (tq > 0), F.sqrt(F.greatest(total, F.lit(0.0)))).otherwise(F.lit(0.0))


def repeated_words(words: str, n: str) -> dict[str, Column]:
    """Steps (added one after the other) to ``_repeated``: words inside 8-word windows found twice or more.

    Windows of 2, 4 and 8 words are hashed in turn; a text whose 4-word windows all differ is done.
    """

    def doubled(of: str, width: int) -> Column:
        left = F.size(of) - width
        return F.zip_with(F.slice(of, F.lit(1), left), F.slice(of, F.lit(1 + width), left), lambda a, b: F.xxhash64(a, b))

    def twice(of: str) -> Column:
        return F.size(F.array_distinct(of)) < F.size(of)

    pairs = F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = F.filter(
        "_pairs",
        lambda p, i: (p["h"] == F.get("_pairs", i - 1)["h"]) | (p["h"] == F.get("_pairs", i + 1)["h"]),
    )
    gaps = F.transform("_places", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", i + 1) - x, F.lit(WINDOW))).cast("long"))
    return {
        "_h1": F.when(F.col(n) >= WINDOW, F.transform(words, lambda w: F.xxhash64(w))),
        "_h2": F.when(F.col("_h1").isNotNull(), doubled("_h1", 1)),
        "_h4": F.when(F.col("_h2").isNotNull(), doubled("_h2", 2)),
        "_h8": F.when(twice("_h4"), doubled("_h4", 4)),
        "_pairs": F.when(twice("_h8"), pairs),
        "_places": F.sort_array(F.transform(same, lambda p: p["i"])),
        "_repeated": F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")),
    }


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept"]


def measure(df: DataFrame, text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """The counts and the verdict of every document beside the columns ``carry`` (all, if not given):
    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (long),
    ``char_distance``, ``word_distance`` (double), ``base_failed`` and ``kept`` (boolean).

    Histograms are written to the shared folder, as they are read twice: for the references and
    for the comparison. References are over the documents of a language that don't fail the counts;
    where there are none, nothing diverges. Null and empty texts have no words and fail. Languages that are null or
    not listed are compared with the documents of all such languages. Repeated rows are judged
    alike. Carried columns with the names of results are left out. An empty input gives an empty
    result.
    """
    names = [c for c in (df.columns if carry is None else carry) if c.lower() not in RESULTS]
    inner = df.select(F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").alias("_tongue"), *[F.col(f"`{c}`").alias(f"in{k}") for k, c in enumerate(names)])
    h = histograms(inner, "_text", "_tongue")
    for name, step in repeated_words("_words", "_n").items():
        h = h.withColumn(name, step)
    h = h.withColumn("_lines", F.filter(F.split(F.coalesce("_text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    h = h.withColumn("_dup", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    h = written(h.select("_lang", "_n", "_word_chars", "_chars", "_common", "_repeated", "_dup", *[f"in{k}" for k in range(len(names))]), "histograms")
    failed = (F.col("_n") < MIN_WORDS) | (100 * F.col("_repeated") > MAX_REPEAT_PERCENT * F.col("_n"))
    # A handful of rows at most, whatever the input's size.
    h = h.join(F.broadcast(references(h.where(~failed))), "_lang", "left")
    h = h.withColumns({"char_distance": js_distance("_chars", "_ref_chars"), "word_distance": js_distance("_common", "_ref_common")})
    far = ((F.col("_n") >= MIN_FOR_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | (
        (F.col("_n") >= MIN_FOR_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    )
    return h.select(
        *[F.col(f"in{k}").alias(c) for k, c in enumerate(names)],
        F.col("_n").alias("n_words"),
        F.col("_word_chars").alias("word_chars"),
        F.col("_chars")[3].alias("n_symbols"),
        F.col("_dup").alias("n_dup_lines"),
        F.col("_repeated").alias("n_repeat_words"),
        "char_distance",
        "word_distance",
        failed.alias("base_failed"),
        (~failed & ~far).alias("kept"),
    )


def keep(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that :func:`measure` keeps, with the input's columns."""
    names = df.columns
    inner = df.toDF(*[f"c{k}" for k in range(len(names))])
    kept = measure(inner, *[f"c{names.index(c)}" for c in (text, lang)]).where("kept")
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
