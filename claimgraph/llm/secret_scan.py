"""Secret scans with built-in functions only: named patterns, and sliding-window entropy over candidate strings.

Matches and the gaps between them come from one pattern applied twice (all matches; a split at the matches), so every
span follows from sums of lengths. Candidates of the entropy scan are runs of 20 or more characters of the base-64 and
hexadecimal alphabets. A window of 20 characters slides along each; the counts of its characters and the sum of
c log2 c over them change by the character that enters and the one that leaves. Windows above the threshold of their
character class (hexadecimal; base 64, which needs a digit and letters of both cases) merge into the span from the
first to the end of the last. Candidates on the allow-list, and spans that touch a span of a named pattern, are left.

Offsets count code points. Defined results: null or empty text has no spans; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The named patterns, in the order in which kinds are listed, and the least length of the part that counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Strings that look random but are not secret (alphabets, placeholders, identifiers of public things).
ALLOW = [r"(?i)example|placeholder|changeme|redacted|dummy", r"(?i)abcdefghij|0123456789abcdef|1234567890", r"^[0-9_=+/-]+$", r"(.)\1{5,}", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"/[a-z]+/|://|^/?[a-z_-]+(/[a-z0-9_-]+)+$"]
WINDOW = 20
HEX_BITS, BASE64_BITS = 3.0, 3.7
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_BLOCK = 256


def running_starts(lengths: Column) -> Column:
    """Sums of all earlier lengths, by sums of whole blocks and the rest, so that long arrays stay cheap."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, x: a + x))
    add = lambda a, x: a + x
    return F.transform(lengths, lambda _, i: F.aggregate(F.slice(blocks, F.lit(1), F.floor(i / _BLOCK).cast("int")), F.lit(0), add) + F.aggregate(F.slice(lengths, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK), F.lit(0), add))


def _spans_of(matches: Column, gaps: Column, kind: int, keep: Column) -> Column:
    """array<struct<start, kind, end, text>> of the matches for which `keep` (an array of booleans) is true."""
    starts = running_starts(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), F.concat(F.array(F.lit(0)), F.transform(matches, F.length)), lambda g, m: F.length(g) + F.coalesce(m, F.lit(0))))
    # running_starts gives the sum before each pair (match i-1, gap i); the pair itself takes us to match i.
    own = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), F.concat(F.array(F.lit(0)), F.transform(matches, F.length)), lambda g, m: F.length(g) + F.coalesce(m, F.lit(0)))
    places = F.slice(F.zip_with(starts, own, lambda a, b: a + b), F.lit(1), F.size(matches))
    rows = F.zip_with(F.arrays_zip(matches.alias("m"), keep.alias("k")), places, lambda x, s: F.struct(s.cast("int").alias("start"), F.lit(kind).alias("kind"), (s + F.length(x["m"])).cast("int").alias("end"), x["m"].alias("text"), x["k"].alias("ok")))
    return F.transform(F.filter(rows, lambda r: r["ok"]), lambda r: F.struct(r["start"], r["kind"], r["end"], r["text"]))


_EMPTY = "array<struct<start:int,kind:int,end:int,text:string>>"


def _none() -> Column:
    return F.array().cast(_EMPTY)


def _weight(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def entropy_spans(candidate: Column) -> Column:
    """(first, last) offsets of windows above their class's threshold in one candidate, nulls if there is none."""
    text = candidate["text"]
    n = F.length(text)
    hexadecimal = F.rlike(text, F.lit(r"^(?:[0-9a-f]+|[0-9A-F]+)$"))
    limit = F.when(hexadecimal, F.lit(HEX_BITS)).otherwise(F.lit(BASE64_BITS))
    base = F.log2(F.lit(float(WINDOW)))
    chars = F.split(text, "")
    start = F.struct(F.array_repeat(F.lit(0), len(_ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def move(counts: Column, place: Column, by: int) -> Column:
        return F.transform(counts, lambda c, j: F.when(j == place, c + by).otherwise(c))

    def step(s: Column, i: Column) -> Column:
        enters = F.instr(F.lit(_ALPHABET), F.get(chars, i))
        leaves = F.when(i >= WINDOW, F.instr(F.lit(_ALPHABET), F.get(chars, i - WINDOW))).otherwise(F.lit(-1))
        c_in = F.get(s["counts"], enters)
        grown = move(s["counts"], enters, 1)
        total = s["sum"] + _weight(c_in + 1) - _weight(c_in)
        c_out = F.coalesce(F.get(grown, leaves), F.lit(0))
        total = total - F.when(leaves >= 0, _weight(c_out) - _weight(c_out - 1)).otherwise(F.lit(0.0))
        high = (i >= WINDOW - 1) & (base - total / WINDOW >= limit)
        at = i - WINDOW + 1
        return F.struct(move(grown, leaves, -1).alias("counts"), total.alias("sum"), F.when(high & (s["first"] < 0), at).otherwise(s["first"]).alias("first"), F.when(high, at).otherwise(s["last"]).alias("last"))

    return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: list[str] = ALLOW) -> DataFrame:
    """(id, base, spans): arrays of (start, kind, end, text), the named patterns' and all, by start and kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t = F.col("__text")
    always = lambda m: F.transform(m, lambda _: F.lit(True))
    rows = df.select(F.col(id_col).alias("id"), text.alias("__text"))
    matches = lambda p, g=0: F.when(F.rlike(t, F.lit(p)), F.regexp_extract_all(t, F.lit(p), F.lit(g))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("id", "__text", matches(ASSIGN).alias("m0"), matches(ACCESS).alias("m1"), matches(HEX).alias("m2"), matches(CANDIDATE).alias("m3"))
    values = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    found = lambda k, p, keep: F.when(F.size(f"m{k}") > 0, _spans_of(F.col(f"m{k}"), F.split(t, p, -1), k, keep)).otherwise(_none())
    plausible = F.transform(F.col("m3"), lambda c: ~F.rlike(c, F.lit("|".join(f"(?:{a})" for a in allow if "\\1" not in a))) & ~F.rlike(c, F.lit(r"(.)\1{5,}")) & F.rlike(c, F.lit("[0-9]")) & (F.rlike(c, F.lit(r"^(?:[0-9a-f]+|[0-9A-F]+)$")) | (F.rlike(c, F.lit("[a-z]")) & F.rlike(c, F.lit("[A-Z]")))))
    rows = rows.select("id", F.concat(found(0, ASSIGN, values), found(1, ACCESS, always(F.col("m1"))), found(2, HEX, always(F.col("m2")))).alias("base"), F.when(F.exists(plausible, lambda x: x), found(3, CANDIDATE, plausible)).otherwise(_none()).alias("candidates"))
    rows = rows.select("id", F.array_sort("base").alias("base"), F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["text"].alias("text"), entropy_spans(c).alias("w"))).alias("scored"))
    extra = F.transform(F.filter("scored", lambda c: c["w"]["first"] >= 0), lambda c: F.struct((c["start"] + c["w"]["first"]).alias("start"), F.lit(3).alias("kind"), (c["start"] + c["w"]["last"] + WINDOW).alias("end"), F.substring(c["text"], c["w"]["first"] + 1, c["w"]["last"] - c["w"]["first"] + WINDOW).alias("text")))
    apart = F.filter(extra, lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    return rows.select("id", "base", F.array_sort(F.concat("base", apart)).alias("spans"))


def named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of its text replaced by a mark, spans that overlap by one; null texts stay null."""
    keep = [F.col(c) for c in df.columns]
    found = scan(df.select(F.struct(*keep).alias("__row"), F.col(text_col).alias(text_col)), "__row", text_col)
    text = F.col(f"id.{text_col}")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        part = F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.array_append(s["parts"], part)).otherwise(s["parts"]).alias("parts"))

    clean = F.aggregate("spans", start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    new = F.when(F.size("spans") > 0, clean).otherwise(text)
    return found.select(*((new if c == text_col else F.col(f"id.`{c}`")).alias(c) for c in df.columns))


def op8(df: DataFrame) -> DataFrame:
    """The digest columns of the secrets contract."""
    found = scan(df)
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return found.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
