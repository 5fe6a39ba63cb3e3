"""Text primitives: tokens, n-grams, similarities, hashes. Column in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """ASCII words, and bigrams of runs of CJK characters (a single one stays), lower-cased."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[\\u4e00-\\u9fff]+|[a-zA-Z0-9_]+"), F.lit(0))
    split = F.transform(
        runs,
        lambda r: F.when(F.rlike(r, F.lit("^[a-zA-Z0-9_]")) | (F.length(r) == 1), F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))),
    )
    return F.flatten(split)


def words(text: Column) -> Column:
    """ASCII words, lower-cased character by character: İ gives i, without the dot that a whole text's lower case sets after it."""
    return F.regexp_extract_all(F.lower(F.translate(text, "İ", "i")), F.lit("[a-zA-Z0-9_]+"), F.lit(0))


def normalised(text: Column) -> Column:
    """Lower case without punctuation and spaces (Unicode words and CJK stay)."""
    return F.regexp_replace(F.trim(F.lower(text)), "(?U)[^\\w\\u4e00-\\u9fff]", "")


def ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams; none of a shorter text."""
    return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def set_sizes(a: Column, b: Column) -> Column:
    """struct<inter, uni>: sizes of the intersection and of the union of two sets."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.struct(n.alias("inter"), (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - n).alias("uni")))


def dice(a: Column, b: Column) -> Column:
    """Twice the intersection over the sum of sizes of two sets."""
    return F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def contained(a: Column, b: Column, share: float = 0.4) -> Column:
    """Whether the intersection is at least a share of the smaller set; an empty set is contained."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(True)).otherwise(F.size(F.array_intersect(a, b)) >= share * least)


def keywords(text: Column) -> Column:
    """Bigrams, trigrams, numbers and Latin words of the normalised text."""
    return let(normalised(text), lambda t: F.array_distinct(F.concat(ngrams(t, 2), ngrams(t, 3), F.regexp_extract_all(t, F.lit("\\d+"), F.lit(0)), F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0)))))


def with_synonyms(words: Column, groups: list[list[str]]) -> Column:
    """words with each member of a synonym group replaced by the group's name."""
    if not groups:
        return words
    m = F.create_map(*[F.lit(x) for i, g in enumerate(groups) for w in g for x in (w, f"__syn_{i}__")])
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(m, w), w)))


def any_of(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether text contains one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def first_of(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """The first word of the list that text contains, or null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words], F.lit(None).cast("string"))


def cache_features(text: Column, synonyms: list[list[str]], products: list[str], actions: dict[str, tuple[str, ...]]) -> Column:
    """struct<year, content, product, acts, words, grams>: all that feature_similarity reads, computed once per text."""
    acts = F.filter(F.array(*[F.when(any_of(text, ws), F.lit(g)) for g, ws in actions.items()]).cast("array<string>"), lambda x: x.isNotNull())

    def of(norm: Column) -> Column:
        return F.struct(
            F.regexp_extract(text, "(20\\d{2})", 1).alias("year"),
            let(F.regexp_replace(norm, "20\\d{2}", ""), lambda bare: F.struct((bare != "").alias("some"), ngrams(bare, 2).alias("grams"))).alias("content"),
            (first_of(text, sorted(products, key=lambda p: -len(p))) if products else F.lit(None).cast("string")).alias("product"),
            acts.alias("acts"),
            with_synonyms(keywords(text), synonyms).alias("words"),
            ngrams(norm, 3).alias("grams"),
        )

    return let(normalised(text), of)


def feature_similarity(x: Column, y: Column) -> Column:
    """0.6 keyword Jaccard + 0.4 trigram Jaccard of two cache_features, 0 behind any guard: years, content, products, actions."""
    years = (x["year"] != "") & (y["year"] != "") & (x["year"] != y["year"])
    content = x["content"]["some"] & y["content"]["some"] & ~F.arrays_overlap(x["content"]["grams"], y["content"]["grams"])
    products = F.coalesce(x["product"] != y["product"], F.lit(False))
    acts = (F.size(x["acts"]) > 0) & (F.size(y["acts"]) > 0) & ~F.arrays_overlap(x["acts"], y["acts"])
    return F.when(years | content | products | acts, F.lit(0.0)).otherwise(0.6 * jaccard(x["words"], y["words"]) + 0.4 * jaccard(x["grams"], y["grams"]))


def cache_similarity(a: Column, b: Column, synonyms: list[list[str]], products: list[str], actions: dict[str, tuple[str, ...]]) -> Column:
    """feature_similarity of two texts."""
    f = lambda t: cache_features(t, synonyms, products, actions)
    return let(F.struct(f(a).alias("x"), f(b).alias("y")), lambda p: feature_similarity(p["x"], p["y"]))


def cache_key(text: Column) -> Column:
    """md5 of the normalised text: the key of exact lookups."""
    return F.md5(normalised(text).cast("binary"))


def content_hash(text: Column) -> Column:
    """sha256 of the text without white space (Unicode)."""
    return F.sha2(F.regexp_replace(text, "(?U)\\s+", ""), 256)


def evidence_hash(hashes: Column) -> Column:
    """sha256 of the sorted content hashes of one answer's evidence, joined by '|'; nulls are left out."""
    return F.sha2(F.array_join(F.array_sort(F.filter(hashes, lambda h: h.isNotNull())), "|"), 256)


def short_hash(text: Column) -> Column:
    """First 12 hex digits of the md5 of the raw text."""
    return F.substring(F.md5(text.cast("binary")), 1, 12)


def signature(text: Column) -> Column:
    """Sorted distinct years and order numbers of a question."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("(?<!\\d)(?:20\\d{2}|\\d{6,})(?!\\d)"), F.lit(0))))


def overlap_ratio(terms: Column, content: Column) -> Column:
    """Share of query terms that content contains, ignoring case."""
    low = F.lower(content)
    return F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t)))) / F.greatest(F.size(terms), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; null if one is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
