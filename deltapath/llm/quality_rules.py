"""Quality rules: base counts, and divergence from language references.

For every document a histogram over character classes and one over the common
words of its language are compared with the references of that language by
Jensen-Shannon distance (base 2, so between 0 and 1).  The references are the
summed histograms of all documents of the language that pass the base rules,
or a table that the caller gives.  Short documents are not judged: a histogram
needs ``HIST_CHARS`` characters or ``HIST_WORDS`` words, and the distance that
sampling alone gives is allowed for.  The bound of the word distance is a share
of the distance that a text without any common word has from the reference, so
such a text is rejected as soon as it is long enough to be judged.

All of it is DataFrame expressions: one pass over the texts writes a small
table of counts, from which references and verdicts are made.

Null and empty texts have no words and fail the base rules.  A null language
is a language of its own; one without a word list is judged by characters
alone.  Repeated rows are judged each on its own, empty tables give empty
results, extra columns play no part and pass through the filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import write_frontier
from .common import WS_CLASS, words_of, written

#: Frequent words of each language, lower case.
COMMON_WORDS = {
    "en": "the of and to a in is that for it was on as with be by at this are from or an not but".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une est que dans qui pour par sur pas au il plus ce se".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más es".split(),
}
N_COMMON = max(map(len, COMMON_WORDS.values()))
LONGEST = max(len(w.encode()) for words in COMMON_WORDS.values() for w in words)
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated windows
HIST_CHARS = 200
HIST_WORDS = 80
CHAR_DISTANCE = 0.15
#: Share of the reference's distance from a text without common words.
WORD_SHARE = 0.6
#: Steps of the distance by which the nearest half is found.
STEPS = 512
#: Languages of which the references may be broadcast.
MAX_LANGUAGES = 10_000
#: Rejected rows (16 bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000
#: Character classes in the order of the histogram; small consonants and digits make the last place.
CLASSES = {
    "upper": r"\p{Lu}",
    "vowel": "[aeiou]",
    "accented": r"[\P{ASCII}&&[^\p{Lu}]]",
    "stop": r"[.,;:!?'\x22()\-]",
    "symbol": r"[#*$%&|<>]",
    "space": f"[{WS_CLASS}]",
}


def _count(text: Column, char: str) -> Column:
    """Characters of a class: what is lost when its runs are deleted."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, f"{char}+", ""))).cast("long")


def repeated_words(windows: Column) -> Column:
    """Words in 3-word windows that occur twice or more; ``windows``: sorted (h, i) of the windows."""
    twin = lambda k: (windows[k - 1]["h"] == windows[k]["h"])
    again = F.filter(windows, lambda x, k: ((k > 0) & twin(F.greatest(k, F.lit(1)))) | ((k < F.size(windows) - 1) & twin(F.least(k + 1, F.size(windows) - 1))))
    at = F.array_sort(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])


def base_counts(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` and doc_id, lang, the base counts, base_failed, and the histograms ``chars`` and ``common``."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(*keep, docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), text.alias("__t"))
    own = F.map_from_arrays(F.array(*map(F.lit, COMMON_WORDS)), F.array(*[F.array(*map(F.lit, w)) for w in COMMON_WORDS.values()]))
    rows = rows.withColumns(
        {
            "__w": words_of(F.col("__t")),
            "__l": F.filter(F.split("__t", "\n"), lambda x: x.rlike(f"[^{WS_CLASS}]")),
            "__k": F.array(*[_count(F.col("__t"), c) for c in CLASSES.values()]),
            "__own": F.coalesce(F.try_element_at(own, F.col("lang")), F.array().cast("array<string>")),
        }
    )
    window = lambda i: F.struct(F.xxhash64(F.col("__w")[i], F.col("__w")[i + 1], F.col("__w")[i + 2]).alias("h"), i.alias("i"))
    rows = rows.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "__g": F.when(F.size("__w") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("__w") - 3), window))),
            "__c": F.filter(F.split(F.lower("__t"), r"[^\p{L}]+"), lambda x: (F.octet_length(x) <= LONGEST) & F.array_contains(F.col("__own"), x)),
        }
    )
    place = list(CLASSES).index
    rows = rows.select(
        *[F.col(c) for c in rows.columns if not c.startswith("__") or c == "__row"],
        F.col("__k")[place("space")].alias("__spaces"),
        F.char_length("__t").cast("long").alias("__n"),
        F.col("__k")[place("symbol")].alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated_words(F.col("__g")), F.lit(0)).cast("long").alias("n_repeat_words"),
        "__k",
        F.size("__c").cast("long").alias("__nc"),
        F.transform("__own", lambda c: F.size(F.filter(F.col("__c"), lambda x: x == c)).cast("long")).alias("__ck"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    seen = F.aggregate("__k", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        *[F.col(c) for c in rows.columns if c == "__row"],
        "doc_id",
        "lang",
        "n_words",
        (F.col("__n") - F.col("__spaces")).alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.array_append("__k", F.greatest(F.col("__n") - seen, F.lit(0))).alias("chars"),
        # The last place counts all other words.
        F.concat(F.slice(F.concat("__ck", F.array_repeat(F.lit(0).cast("long"), N_COMMON)), 1, N_COMMON), F.array(F.greatest(F.col("n_words") - F.col("__nc"), F.lit(0)))).alias("common"),
    )


def references(counts: DataFrame) -> DataFrame:
    """(lang, ref_chars, ref_common) of the corpus.

    A first reference sums up the documents that pass the base rules, a second
    one the half of them that is nearest to the first, so that junk in the
    corpus doesn't shift what documents are compared with.
    """
    passing = counts.where(~F.col("base_failed"))
    first = written(summed(passing), "references")
    judged = with_verdicts(passing, first, keep_histograms=True).withColumn("__bin", F.floor(F.col("char_distance") * STEPS))
    bins = judged.where("__bin is not null").groupBy("lang", "__bin").agg(F.count(F.lit(1)).alias("n"))  # up to STEPS + 1 rows a language
    of_lang = Window.partitionBy("lang")
    bins = bins.withColumns({"upto": F.sum("n").over(of_lang.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(of_lang)})
    cut = written(bins.where("2 * upto >= all").groupBy("lang").agg(F.min("__bin").alias("__cut")).withColumnRenamed("lang", "__l"), "cuts")
    near = judged.join(_few(cut, cut.count()), F.col("lang").eqNullSafe(F.col("__l")) & (F.col("__bin") <= F.col("__cut")), "left_semi")
    second = written(summed(near), "references")
    have = second.select(F.col("lang").alias("__l"))
    rest = first.join(have, F.col("lang").eqNullSafe(F.col("__l")), "left_anti")  # languages of short documents only
    return written(second.unionByName(rest), "references")


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_LANGUAGES else df


def summed(counts: DataFrame) -> DataFrame:
    """Histograms of each language, summed up."""
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)] + [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(N_COMMON + 1)]
    found = counts.groupBy("lang").agg(*sums)
    return found.select(
        "lang",
        F.array(*[f"c{i}" for i in range(len(CLASSES) + 1)]).alias("ref_chars"),
        F.array(*[f"w{i}" for i in range(N_COMMON + 1)]).alias("ref_common"),
    )


def js_distance(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of an array of counts that sum up to ``total`` from an array of shares; null if either is all zero."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    each = F.zip_with(counts, shares, lambda c, b: part(c / total, b) + part(b, c / total))
    return F.when((total > 0) & shares.isNotNull(), F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0))))


def _noise(n: Column, k: int) -> Column:
    """About the distance of a sample of ``n`` from its own distribution over ``k`` places."""
    return F.sqrt((k - 1) / (8 * math.log(2) * F.greatest(n, F.lit(1))))


def word_bound(shares: Column, most: Column, n: Column) -> Column:
    """Greatest word distance that is kept: ``WORD_SHARE`` of ``most`` and what a sample of ``n`` words of the
    reference gives, added as squares.  A place gives its share at most, however small the sample."""
    each = F.transform(shares, lambda p: F.least(p, (1 - p) / (8 * math.log(2) * F.greatest(n, F.lit(1)))))
    return F.sqrt(F.pow(WORD_SHARE * most, F.lit(2)) + F.aggregate(each, F.lit(0.0), lambda a, x: a + x))


def with_verdicts(counts: DataFrame, refs: DataFrame, keep_histograms: bool = False) -> DataFrame:
    """``counts`` with the two distances and ``kept``."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
    n = refs.count()  # a row per language
    refs = refs.select(F.col("lang").alias("__lang"), "ref_chars", "ref_common", total("ref_chars").alias("__rc"), total("ref_common").alias("__rw"))
    shares = lambda c, t: F.when(F.col(t) > 0, F.transform(c, lambda y: y / F.col(t)))
    refs = refs.select("__lang", shares("ref_chars", "__rc").alias("ref_chars"), shares("ref_common", "__rw").alias("ref_common"))
    no_common = F.array(*[F.lit(0)] * N_COMMON, F.lit(1))
    refs = written(refs.withColumn("__most", js_distance(no_common, F.lit(1), F.col("ref_common"))), "shares")
    rows = counts.join(_few(refs, n), F.col("lang").eqNullSafe(F.col("__lang")), "left")
    rows = rows.withColumns({"__nc": total("chars"), "__nw": total("common")})
    chars = F.col("__nc")
    rows = rows.withColumns(
        {
            "char_distance": F.when(chars >= HIST_CHARS, js_distance(F.col("chars"), chars, F.col("ref_chars"))),
            "word_distance": F.when((F.col("n_words") >= HIST_WORDS) & F.col("lang").isin(*COMMON_WORDS), js_distance(F.col("common"), F.col("__nw"), F.col("ref_common"))),
        }
    )
    far = F.coalesce(F.col("char_distance") > CHAR_DISTANCE + _noise(chars, len(CLASSES) + 1), F.lit(False))
    odd = F.coalesce(F.col("word_distance") > word_bound(F.col("ref_common"), F.col("__most"), F.col("__nw")), F.lit(False))
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~far & ~odd).drop("__lang", "ref_chars", "ref_common", "__most", "__nc", "__nw")
    return rows if keep_histograms else rows.drop("chars", "common")


def judge(docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """The verdict of every document, with counts and distances."""
    counts = written(base_counts(docs), "counts")
    return with_verdicts(counts, references(counts) if refs is None else refs)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept.

    Texts are read once for the counts and once to be passed on: rows are told
    apart by doc_id and a hash of text and language, and the rejected ones are
    left out by a join (broadcast if their counted number allows).
    """
    print_ = F.xxhash64(F.coalesce(docs["text"], F.lit("")), docs["lang"].cast("string"))
    counts = written(base_counts(docs, print_.alias("__row")), "counts")
    judged = with_verdicts(counts, references(counts))
    rejected = judged.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("__row").alias("__print")).distinct()
    rejected, n = write_frontier(rejected, "rejected")
    drop = F.broadcast(rejected) if n <= BROADCAST_ROWS else rejected
    return docs.join(drop, (print_ == drop["__print"]) & docs["doc_id"].cast("long").eqNullSafe(drop["__id"]), "left_anti")
