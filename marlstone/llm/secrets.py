"""Secret scans: base patterns, and tokens that a battery of randomness tests can't tell from random strings.

For each token of an inferred encoding (of a token that none fits, for each of its parts): a chi-squared test of
uniformity over the alphabet, a runs test and a lag-1 serial correlation test, combined by Fisher's method; a
chi-squared test of the numbers of capitals, small letters and other characters, which words of letters alone fail; and
a test of the number of changes between these classes and digits, which identifiers of several words and paths fail.
Bonferroni joins the three. The hypothesis is that the token is random; Benjamini and Hochberg's procedure, run apart for each encoding and length
band, decides which tokens are ordinary. Those that stay are secrets: at most fdr of what a band dismisses is expected to
be random. That bounds what is missed, not what is flagged: ordinary tokens that look random in all tests are flagged too.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, keep, let, spans_of, text_of
from marlstone.llm.pii import masked

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: One of these stands, in either case, in every text that ASSIGN matches in.
HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = "AKIA[A-Z0-9]++"
HEX = "[0-9a-f]++"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
#: Part of a token that no encoding fits: it has characters of both 64-letter alphabets.
PART = "[A-Za-z0-9]{16,}+={0,2}"
SPAN = "struct<s:int,k:int,e:int,kind:string,m:string>"
HEX_DIGITS = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
UPPER36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER36 = "0123456789abcdefghijklmnopqrstuvwxyz"
ALNUM62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
URL64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
#: Encodings, narrowest first: name, what its tokens look like, its alphabet.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", HEX_DIGITS),
    ("hex_upper", "^[0-9A-F]+$", HEX_DIGITS.upper()),
    ("base32", "^[A-Z2-7]+$", BASE32),
    ("upper36", "^[0-9A-Z]+$", UPPER36),
    ("lower36", "^[0-9a-z]+$", LOWER36),
    ("alnum62", "^[0-9A-Za-z]+$", ALNUM62),
    ("base64", "^[0-9A-Za-z+/]+$", BASE64),
    ("url64", "^[0-9A-Za-z_-]+$", URL64),
)
#: Steps of a p-value's decimal logarithm in which rejections are counted.
STEPS = 10
LOWEST = 12


@dataclass(frozen=True)
class Battery:
    fdr: float = 0.05


def _normal_tail(z: Column) -> Column:
    """P(N > z) for z >= 0: Abramowitz and Stegun 26.2.17 (error below 1e-7)."""

    def tail(z: Column) -> Column:
        poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-z * z / 2) / 2.5066282746310002 * let(1 / (1 + 0.2316419 * z), poly)

    return let(z, tail)


def _upper(z: Column) -> Column:
    return let(z, lambda z: F.when(z >= 0, _normal_tail(z)).otherwise(1 - _normal_tail(-z)))


def _alphabet(name: str, letters: str) -> Column:
    """What the tests ask of an encoding, as constants: its name n, letters a and their number size; how many are capitals,
    small letters and others; the probability q that a pair of characters changes between capitals, small letters, digits
    and others, and that two neighbouring pairs both do (b)."""
    size = float(len(letters))
    upper, lower, digits = (float(sum(lo <= c <= hi for c in letters)) for lo, hi in ("AZ", "az", "09"))
    same = both = 0.0
    for f in (upper / size, lower / size, digits / size, (size - upper - lower - digits) / size):
        same, both = same + f * f, both + f * (1 - f) * (1 - f)
    values = {"n": name, "a": letters, "size": size, "upper": upper, "lower": lower, "other": size - upper - lower, "q": 1 - same, "b": both}
    return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])


def _battery(token: Column, x: Column) -> Column:
    """Combined p-value of a token without padding, by the alphabet x. Every value that is used twice is bound by let():
    an expression is computed anew wherever it stands."""

    def tests(y: Column) -> Column:
        c, n, size = y["c"], y["n"], x["size"]
        # Eight cells of equal width: few enough for short tokens. Cells of an uneven alphabet have uneven weights.
        width = lambda b: (F.ceil((b + 1) * size / 8) - F.ceil(b * size / 8)).cast("double")
        off = lambda cells, b: let(n * width(b) / size, lambda e: F.pow(F.size(F.filter(cells, lambda v: v == b)) - e, F.lit(2)) / e)
        chi = let(F.transform(c, lambda v: F.floor(v * 8 / size)), lambda cells: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda acc, b: acc + off(cells, b)))
        # Wilson and Hilferty: the cube root of a chi-squared variable is nearly normal.
        z_chi = (F.pow(chi / 7, F.lit(1 / 3)) - (1 - 2 / 63)) / (2 / 63) ** 0.5

        def z_runs(above: Column) -> Column:
            n1 = F.aggregate(above, F.lit(0), lambda a, v: a + v).cast("double")
            runs = F.aggregate(above, F.struct(F.lit(0).alias("r"), F.lit(-1).alias("p")), lambda a, v: F.struct((a["r"] + (a["p"] != v).cast("int")).alias("r"), v.alias("p")))["r"]
            mean = let(n1, lambda n1: 2 * n1 * (n - n1) / n + 1)
            z = lambda mean, var: F.when(var > 0, F.abs(runs - mean) / F.sqrt(var)).otherwise(F.sqrt(n))
            return let(mean, lambda mean: let((mean - 1) * (mean - 2) / (n - 1), lambda var: z(mean, var)))

        def z_ser(mid: Column) -> Column:
            den = F.aggregate(c, F.lit(0.0), lambda a, v: a + (v - mid) * (v - mid))
            num = F.aggregate(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda u, v: (u - mid) * (v - mid)), F.lit(0.0), lambda a, v: a + v)
            return let(den, lambda den: F.when(den > 0, F.abs(num / den) * F.sqrt(n)).otherwise(F.sqrt(n)))

        runs = let(F.transform(c, lambda v: (v >= size / 2).cast("int")), z_runs)
        serial = let(F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / n, z_ser)
        ln = lambda p: F.log(F.greatest(p, F.lit(1e-15)))
        half = -(ln(_upper(z_chi)) + ln(2 * _normal_tail(runs)) + ln(2 * _normal_tail(serial)))
        # Fisher: minus twice the sum of logs is chi-squared with six degrees; its tail has a closed form.
        fisher = let(half, lambda half: F.exp(-half) * (1 + half + half * half / 2))
        return F.least(F.lit(1.0), 3 * F.least(fisher, classes(n), switches(n)))

    def classes(n: Column) -> Column:
        """p-value of the numbers of capitals, small letters and others; an alphabet of one case has two classes."""
        size = x["size"]
        upper, lower = (F.length(F.regexp_replace(token, out, "")).cast("double") for out in ("[^A-Z]", "[^a-z]"))
        part = lambda got, of: F.when(of > 0, let(n * of / size, lambda e: F.pow(got - e, F.lit(2)) / e)).otherwise(0.0)
        chi = let(F.struct(upper.alias("u"), lower.alias("l")), lambda g: part(g["u"], x["upper"]) + part(g["l"], x["lower"]) + part(n - g["u"] - g["l"], x["other"]))
        return let(chi, lambda chi: F.when((x["upper"] > 0) & (x["lower"] > 0), F.exp(-chi / 2)).otherwise(2 * _normal_tail(F.sqrt(chi))))

    def switches(n: Column) -> Column:
        """p-value of few changes between capitals, small letters, digits and others: identifiers keep to a class for long."""
        runs = F.regexp_count(token, F.lit("[A-Z]++|[a-z]++|[0-9]++|[^A-Za-z0-9]++")).cast("double")
        q, b = x["q"], x["b"]
        return _upper(((n - 1) * q - (runs - 1)) / F.sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * (b - q * q)))

    codes = F.transform(F.split(token, ""), lambda c: (F.position(c, x["a"]) - 1).cast("double"))
    return let(F.struct(codes.alias("c"), F.length(token).cast("double").alias("n")), tests)


def randomness(token: Column) -> Column:
    """struct<encoding,p>: inferred encoding of a token and the combined p-value of the tests; null if none fits."""

    def fitting(bare: Column) -> Column:
        found = F  # the first that fits
        for name, look, letters in ENCODINGS:
            found = found.when(F.rlike(bare, F.lit(look)), _alphabet(name, letters))
        tested = lambda x: F.struct(x["n"].alias("encoding"), F.when(F.length(bare) >= 16, _battery(bare, x)).alias("p"))
        return let(found, lambda x: F.when(x.isNotNull(), tested(x)))

    return let(F.rtrim(token, F.lit("=")), fitting)


def _band(token: Column) -> Column:
    return F.floor(F.log2(F.length(token).cast("double"))).cast("int")


def scan(docs: DataFrame, text: str, b: Battery) -> DataFrame:
    """docs with __assign, __access, __hex (base spans) and __tokens (candidates that overlap no base span, tested)."""
    t = text_of(F.col(text))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def kind(spans: Column, name: str, ok) -> Column:
        return F.transform(F.filter(spans, ok), lambda x: F.struct(x["s"], F.lit(KINDS.index(name)).alias("k"), x["e"], F.lit(name).alias("kind"), x["m"]))

    def assigned(x: Column) -> Column:
        return F.length(F.regexp_replace(x["m"], ASSIGN_HEAD, "")) >= 12

    def inside(x: Column, pattern: str) -> Column:
        """Spans of a pattern within a span."""
        return F.transform(spans_of(x["m"], pattern), lambda y: F.struct((x["s"] + y["s"]).alias("s"), (x["s"] + y["e"]).alias("e"), y["m"].alias("m")))

    hinted = reduce(or_, (F.contains(F.lower(t), F.lit(w)) for w in HINTS))
    out = docs.withColumn("__runs", spans_of(t, TOKEN)).withColumns(
        {
            "__assign": kind(F.when(hinted, spans_of(t, ASSIGN)).otherwise(none), "assign", assigned),
            "__access": kind(F.when(F.contains(t, F.lit("AKIA")), spans_of(t, ACCESS)).otherwise(none), "access", lambda x: F.length(x["m"]) >= 18),
            # Only runs of 16 and more can pass: shorter ones are never built. Each lies in one run of a token's characters.
            "__hex": kind(F.flatten(F.transform("__runs", lambda x: inside(x, HEX[:-2] + "{16,}+"))), "hex", lambda x: F.length(x["m"]) >= 16),
        }
    )
    base = F.concat("__assign", "__access", "__hex")

    def whole_or_parts(x: Column) -> Column:
        return F.when(F.rlike(x["m"], F.lit("[+/]")) & F.rlike(x["m"], F.lit("[_-]")), inside(x, PART)).otherwise(F.array(x))

    def free(x: Column) -> Column:
        return ~F.exists(base, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))

    tokens = F.transform(F.filter(F.flatten(F.transform("__runs", whole_or_parts)), free), lambda x: F.struct(x["s"], x["e"], x["m"], randomness(x["m"]).alias("r"), _band(x["m"]).alias("band")))
    return out.withColumn("__tokens", F.filter(tokens, lambda x: x["r"]["p"].isNotNull())).drop("__runs")


def dismissals(scanned: DataFrame, b: Battery) -> DataFrame:
    """encoding, band, level: tokens with p at or below level are ordinary. At most encodings x 31 rows.

    Every token of the corpus counts; rejections are counted in steps of the p-value's logarithm, so that no
    group of p-values is ever sorted in one task.
    """
    steps = STEPS * LOWEST
    p = F.greatest(F.col("x.r.p"), F.lit(10.0**-LOWEST))
    # The step j of p: the largest j with p <= 10^(-j / STEPS).
    step = F.least(F.lit(steps), F.greatest(F.lit(0), F.floor(-F.log10(p) * STEPS + 1e-9))).cast("int")
    per = scanned.select(F.explode("__tokens").alias("x")).groupBy(F.col("x.r.encoding").alias("encoding"), F.col("x.band").alias("band"), step.alias("j")).agg(F.count("*").alias("n"))
    bands = per.groupBy("encoding", "band").agg(F.sum("n").alias("m"), F.collect_list(F.struct("j", "n")).alias("js"))  # at most steps + 1 entries
    passing = F.filter(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda j: F.col("m") * F.pow(F.lit(10.0), -j / STEPS) <= b.fdr * F.aggregate(F.filter("js", lambda y: y["j"] >= j), F.lit(0).cast("long"), lambda a, y: a + y["n"]),
    )
    return bands.select("encoding", "band", F.array_min(passing).alias("j")).filter("j is not null").select("encoding", "band", F.pow(F.lit(10.0), -F.col("j") / STEPS).alias("level"), "j")


def _secret(levels: list, x: Column) -> Column:
    """Whether the tests let token x stand as random. levels: rows of dismissals()."""
    out = F.lit(True)
    for row in levels:
        out = out & ~((x["r"]["encoding"] == row["encoding"]) & (x["band"] == row["band"]) & (x["r"]["p"] <= row["level"]))
    return out


def _found(levels: list) -> Column:
    return F.transform(F.filter("__tokens", lambda x: _secret(levels, x)), lambda x: F.struct(x["s"], F.lit(3).alias("k"), x["e"], F.lit("random").alias("kind"), x["m"]))


def find_secrets(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), battery: Battery | None = None) -> DataFrame:
    """Secrets of every whole text: carry columns, the base spans assign, access, hex, and random (by the tests).

    Each is an array<struct<s,k,e,kind,m>>: start and end (exclusive) in code points, kind, match.
    Null text: empty, without spans. Repeated rows and ids keep their rows. Tokens that overlap a base span are
    not tested. Columns other than text and carry are not read. An empty table gives no rows.
    """
    b = battery or Battery()
    src = docs.select(*[F.col(c) for c in carry], F.col(text).alias("__text"))
    s = cut(scan(src, "__text", b).drop("__text"))
    levels = dismissals(s, b).collect()  # at most encodings x 31 rows
    return s.select(*carry, *[F.col(f"__{k}").alias(k) for k in KINDS[:3]], _found(levels).alias("random"))


def mask_secrets(docs: DataFrame, text: str = "text", battery: Battery | None = None) -> DataFrame:
    """docs with every secret in text replaced by <KIND>; other columns and rows stay."""
    b = battery or Battery()
    s = keep(scan(docs, text, b), "secrets")
    levels = dismissals(s, b).collect()  # at most encodings x 31 rows
    spans = F.array_sort(F.concat("__assign", "__access", "__hex", _found(levels)))
    return s.withColumn(text, F.when(F.size(spans) > 0, masked(F.col(text), spans)).otherwise(F.col(text))).select(*docs.columns)
