"""Secret scan by a randomness test battery (operator 7), in DataFrame functions only.

Base kinds are found by pattern.  Beyond them, every run of at least 20 token characters is a
candidate.  Its encoding is inferred (hexadecimal, base 32 or base 64), its characters become
numbers in that alphabet, and three tests ask whether they look drawn at random: chi-squared
uniformity, runs above and below the middle, and serial correlation at lag one.  Short tokens
can't fill a cell for every character, so uniformity is taken over a few cells of the alphabet,
chosen where text departs from chance (common letters, other letters, capitals, digits), until
each character may be expected five times.  The p-values are combined by Bonferroni's rule.

False discoveries are controlled by length: candidates made of words (of letters in one case, or
identifiers and paths of words and short numbers) serve as decoys, together with built-in ones
(``decoy_texts``), so that every stratum of encoding and length has decoys at any size of the
table.  Within each stratum the least p-value bar is taken at which the decoys' pass rate, carried
over to the other candidates, explains at most ``fdr`` of those that pass.  All rows are counted;
the table of counts has a fixed size (strata x bins), so it alone goes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.names import free_name
from webloom.shared import discard, written

# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
CELLS = {
    "hex": ["01234", "56789", "abc", "def"],
    "base32": ["ETAOINSHR", "BCDFGJKLMPQUVWXYZ", "234567"],
    "base64": ["etaoinshr", "bcdfgjklmpquvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789+/"],
}
#: What decoys are made of: words with a short number, or words in capitals.
WORDS = [r"[A-Z]?[a-z]{2,}[0-9]{0,4}[-_/=+]*", r"[A-Z]{2,}[-_/=+]*"]
KINDS = ["assign", "access", "hex", "random"]
_BLOCK = 256
_BINS = 24
_LENGTHS = [32, 48, 80]
# The words of built-in decoys, and those that are hexadecimal as well.
DECOY_WORDS = (
    "account action address amount archive array batch bucket buffer builder cache channel client column config content context counter "
    "customer database default delete detail device document element event export factory field file filter folder format function group "
    "handler header helper history image import index input invoice item language layout library limit list loader location manager market "
    "member message method module monitor name network number object option order output package page parent parser password path payment "
    "pending period plugin point policy process product profile project query queue reader record region report request response result "
    "sample schedule search section select server service session setting source status storage store string summary supplier system table "
    "target template ticket total transfer update user value vendor version view window worker writer"
).split()
HEX_WORDS = "accede added babe bead bed cab cafe dad dead deaf decade deed ebb efface fab facade face fad fade fed feed".split()
#: (words, form, separator) of built-in decoys; None is digits.
_STYLES = [(DECOY_WORDS, "lower", "_"), (DECOY_WORDS, "camel", ""), (DECOY_WORDS, "numbered", "-"), (DECOY_WORDS, "numbered", "/"), (DECOY_WORDS, "upper", "_"), (DECOY_WORDS, "upper", ""), (HEX_WORDS, "numbered", ""), (None, "", "")]
_DECOY_LENGTHS = [20, *_LENGTHS, 160]
_DECOY_PARTS = 60
_SPAN = "array<struct<start:int,end:int>>"


def match_spans(text: Column, pattern: str) -> Column:
    """[start, end) code points of the leftmost non-overlapping matches.

    The gaps between matches and the matches alternate, so positions are running sums of their
    lengths: summed in blocks, so that a text with very many matches stays near linear.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int")), lambda b: F.slice(pairs, b * _BLOCK + 1, _BLOCK))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, p: a + p["gap"] + p["len"]))
    heads = F.aggregate(totals, F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t)))

    def block(b: Column, head: Column) -> Column:
        begin = F.struct(head.alias("at"), F.array().cast(_SPAN).alias("out"))
        step = lambda a, p: F.struct(
            (a["at"] + p["gap"] + p["len"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + p["gap"]).alias("start"), (a["at"] + p["gap"] + p["len"]).alias("end")))).alias("out"),
        )
        return F.aggregate(b, begin, step)["out"]

    return F.flatten(F.zip_with(blocks, F.slice(heads, 1, F.size(blocks)), block))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal, by its logistic approximation."""
    return _let(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), z)), lambda z: 1 / (1 + F.exp(z * 1.5976 + F.pow(z, F.lit(3.0)) * 0.07056)))


def _chi_tail(chi: Column, df: int) -> Column:
    """Upper tail of chi-squared, by the cube root of it that is close to normal."""
    return _tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)


def battery(token: Column, encoding: str) -> Column:
    """p_chi, p_runs, p_serial and the combined p of a token; padding '=' doesn't count."""
    m = len(ALPHABETS[encoding])
    clean = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/") if m == 64 else F.rtrim(F.lower(token) if m == 16 else token, F.lit("="))
    tests = _let(F.struct(clean.alias("clean"), F.length(clean).cast("double").alias("size")), lambda t: _three_tests(t["clean"], t["size"], encoding))
    return _let(tests, lambda t: F.struct(t["p_chi"].alias("p_chi"), t["p_runs"].alias("p_runs"), t["p_serial"].alias("p_serial"), F.least(F.lit(1.0), 3 * F.least(t["p_chi"], t["p_runs"], t["p_serial"])).alias("p")))


def _three_tests(clean: Column, size: Column, encoding: str) -> Column:
    alphabet = ALPHABETS[encoding]
    m = len(alphabet)
    values = F.transform(F.filter(F.split(clean, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)

    cells = [_let(F.length(clean) - F.length(F.translate(clean, c, "")) - len(c) / m * size, lambda d: d * d) / (len(c) / m * size) for c in CELLS[encoding]]
    p_cells = _chi_tail(sum(cells, F.lit(0.0)), len(cells) - 1)
    same = F.aggregate(
        F.array_sort(values),
        F.struct(F.lit(-2).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares")),
        lambda a, v: F.struct(v.alias("last"), F.when(v == a["last"], a["run"] + 1).otherwise(1.0).alias("run"), (a["squares"] + F.when(v == a["last"], 2 * a["run"] + 1).otherwise(1.0)).alias("squares")),
    )
    p_chi = F.when(size >= 5 * m, _chi_tail(same["squares"] * m / size - size, m - 1)).otherwise(p_cells)

    middle = (m - 1) / 2
    zero = F.lit(0.0)
    walk = F.aggregate(
        values,
        F.struct(F.lit(None).cast("double").alias("last"), zero.alias("runs"), zero.alias("high"), zero.alias("cross"), zero.alias("power")),
        lambda a, v: F.struct(
            (v - middle).alias("last"),
            (a["runs"] + F.when(a["last"].isNull() | ((a["last"] > 0) != (v > middle)), 1.0).otherwise(0.0)).alias("runs"),
            (a["high"] + F.when(v > middle, 1.0).otherwise(0.0)).alias("high"),
            (a["cross"] + F.coalesce(a["last"], zero) * (v - middle)).alias("cross"),
            (a["power"] + (v - middle) * (v - middle)).alias("power"),
        ),
    )

    def along(w: Column) -> Column:
        def scored(mean: Column) -> Column:
            spread = (mean - 1) * (mean - 2) / (size - 1)
            # Runs are whole numbers: the correction by a half keeps short tokens' p-values honest.
            z_runs = F.when(spread > 0, F.greatest(F.lit(0.0), F.abs(w["runs"] - mean) - 0.5) / F.sqrt(spread)).otherwise(20.0)
            z_serial = F.when(w["power"] > 0, F.abs(w["cross"] / w["power"]) * F.sqrt(size)).otherwise(20.0)
            return F.struct(p_chi.alias("p_chi"), F.least(F.lit(1.0), 2 * _tail(z_runs)).alias("p_runs"), F.least(F.lit(1.0), 2 * _tail(z_serial)).alias("p_serial"))

        return _let(w["high"] * 2 * (size - w["high"]) / size + 1, scored)

    return _let(walk, along)


def made_of_words(token: Column) -> Column:
    """Whether nothing is left of a token without its words; as replacement, which no long token can overflow."""
    bare = [F.regexp_replace(token, F.lit(p), F.lit("")) == "" for p in WORDS]
    return bare[0] | bare[1] | token.rlike("^[-_=+/]+$") | token.rlike("^[0-9]+$")


def _judged(text: Column, base: Column) -> Column:
    """Candidates off the base spans: start, end, stratum, bin of the p-value, and whether a decoy."""
    spans = match_spans(text, CANDIDATE)
    tokens = F.zip_with(spans, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), t.alias("token")))
    free = F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))

    def judge(t: Column) -> Column:
        token = t["token"]
        hexa, upper = token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), token.rlike("^[A-Z2-7]+=*$")
        kind = F.when(hexa, 0).when(upper, 1).otherwise(2)
        p = F.when(hexa, battery(token, "hex")["p"]).when(upper, battery(token, "base32")["p"]).otherwise(battery(token, "base64")["p"])
        size = t["end"] - t["start"]
        length = sum((F.when(size >= n, 1).otherwise(0) for n in _LENGTHS), F.lit(0))
        place = F.least(F.lit(_BINS - 1), F.floor(-F.log2(F.greatest(p, F.lit(1e-12)))).cast("int"))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), (kind * 10 + length).alias("stratum"), place.alias("bin"), made_of_words(token).alias("decoy"))

    return F.transform(free, judge)


def decoy_texts(spark: SparkSession, each: int) -> DataFrame:
    """text: built-in decoys, ``each`` for every style and range of lengths.

    Identifiers, paths, capitals, hexadecimal words and digits are put together from listed words
    by a hash of the row's number, so they are the same in every run.  A token is cut at its
    length, so that a single letter may be left at its end; such tokens aren't made of words and
    don't count.
    """
    rows = spark.range(len(_STYLES) * len(_LENGTHS + [0]) * each)
    style, length = F.col("id") % len(_STYLES), F.floor(F.col("id") / len(_STYLES)) % (len(_LENGTHS) + 1)

    def joined(words: list[str] | None, form: str, separator: str) -> Column:
        def part(j: Column) -> Column:
            drawn = F.pmod(F.xxhash64("id", j), F.lit(1 << 20))
            number = F.pmod(F.xxhash64(j, "id"), F.lit(10_000)).cast("string")
            if words is None:
                return number
            word = F.element_at(F.array(*map(F.lit, words)), (drawn % len(words) + 1).cast("int"))
            if form == "camel":
                return F.when(j > 0, F.initcap(word)).otherwise(word)
            return F.upper(word) if form == "upper" else F.concat(word, F.when(j % 3 == 2, number).otherwise("")) if form == "numbered" else word

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(_DECOY_PARTS - 1)), part), separator)

    text, size = F.lit(None).cast("string"), F.lit(0)
    for i, one in enumerate(_STYLES):
        text = F.when(style == i, joined(*one)).otherwise(text)
    for i, (low, high) in enumerate(zip(_DECOY_LENGTHS, _DECOY_LENGTHS[1:])):
        size = F.when(length == i, low + F.pmod(F.xxhash64("id"), F.lit(high - low))).otherwise(size)
    return rows.select(F.substring(text, F.lit(1), size.cast("int")).alias("text"))


def _bars(counts: list, fdr: float, level_bin: int) -> dict[int, int]:
    """For each stratum the highest bin (least p-value) that still counts as random, -1 for none."""
    by: dict[int, dict[tuple[bool, int], int]] = {}
    for r in counts:
        have = by.setdefault(r["stratum"], {})
        have[r["decoy"], r["bin"]] = have.get((r["decoy"], r["bin"]), 0) + r["n"]
    bars = {}
    for stratum, have in by.items():
        known = sum(n for (d, _), n in have.items() if d)
        others = sum(n for (d, _), n in have.items() if not d)
        bar = -1
        for b in range(level_bin + 1 if known else 0):
            wrong = (1 + sum(have.get((True, i), 0) for i in range(b + 1))) / known * others
            right = sum(have.get((False, i), 0) for i in range(b + 1))
            if right and wrong <= fdr * right:
                bar = b
        bars[stratum] = bar
    return bars


def scan_secrets(docs: DataFrame, fdr: float = 0.05, level: float = 0.01, decoys: int = 200, keep: list[str] | None = None, spans_as: str = "spans") -> DataFrame:
    """Finds secrets in every text.

    ``docs``: doc_id, text; more columns are ignored unless named in ``keep``.  Returns a row
    per row of docs: doc_id, the kept columns, and ``spans_as``, an array of (kind, start, end) in
    code points, end exclusive, by start and then kind (assign, access, hex, random).  Null
    texts are empty and have no spans; repeated rows each give a row with the same spans; an
    empty table gives an empty result.  Very long texts are scanned whole.  Spans with the same
    start are ordered by kind.  ``decoys`` built-in ones are made for each style and range of
    lengths, whatever the table holds (see ``decoy_texts``).  Kept columns may have any names but that of ``spans_as``.
    """
    kept = ["doc_id", *(c for c in (keep or []) if c != "doc_id")]
    if free_name(kept, spans_as) != spans_as:
        raise ValueError(f"{spans_as} is the name of a kept column")
    # Kept columns travel in one struct, so none of their names meets a name used here.
    raw = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text, none = F.col("text"), F.array().cast(_SPAN)

    maybe = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN)
    passes = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda g: F.length(g) >= 8)
    assign = F.filter(F.zip_with(match_spans(text, ASSIGN), passes, lambda s, ok: F.struct(s["start"].alias("start"), s["end"].alias("end"), ok.alias("ok"))), lambda s: s["ok"])
    base = raw.select(
        "*",
        F.when(maybe, F.transform(assign, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(none).alias("assign"),
        F.when(F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS), match_spans(text, ACCESS)).otherwise(none).alias("access"),
        F.when(text.rlike(HEX), match_spans(text, HEX)).otherwise(none).alias("hex"),
    )
    joined = F.concat("assign", "access", "hex")
    found = base.select(
        "row", "assign", "access", "hex",
        F.when(text.rlike(CANDIDATE), _judged(text, joined)).otherwise(F.array().cast("array<struct<start:int,end:int,stratum:int,bin:int,decoy:boolean>>")).alias("more"),
    )
    found = written(found, "secrets-found")
    # Written first: else the making of a text would be repeated wherever its judgement names it.
    made = written(decoy_texts(docs.sparkSession, decoys), "secrets-decoys")
    judged = found.select(F.inline("more")).unionByName(made.select(F.inline(_judged(F.col("text"), none))).where("decoy"))
    counts = judged.groupBy("stratum", "decoy", "bin").agg(F.count("*").alias("n")).collect()
    discard(made)
    level_bin = next(b for b in range(_BINS) if 2.0 ** -(b + 1) < level)
    bars = _bars(counts, fdr, level_bin)

    def passes_bar(c: Column) -> Column:
        within = F.lit(False)
        for stratum, b in sorted(bars.items()):
            within = within | ((c["stratum"] == stratum) & (c["bin"] <= b))
        return within & ~c["decoy"]

    def tagged(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    everything = F.concat(tagged(F.col("assign"), 0), tagged(F.col("access"), 1), tagged(F.col("hex"), 2), tagged(F.filter("more", passes_bar), 3))
    names = F.array(*(F.lit(k) for k in KINDS))
    spans = F.transform(F.array_sort(everything), lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(*(F.col("row").getField(c).alias(c) for c in kept), spans.alias(spans_as))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """A text with its spans, merged where they overlap, replaced by a mark."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))).alias("out"),
        )
    )
    end = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, end)).otherwise(text)


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), count("random").alias("n_random"))
