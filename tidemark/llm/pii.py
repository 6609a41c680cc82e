"""Personal data by regular expressions, checksums and context words, in built-in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Proposals. Each equals its plain form, with possessive repeats and a look-behind that spare retries
# inside a run of characters in which no match can start.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Length of an IBAN by country: fixed values of the registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def _iban() -> str:
    """For each length, its countries, two check digits and as many characters, in groups or not."""
    lengths = sorted(set(IBAN_LENGTHS.values()))
    forms = ("(?:" + "|".join(c for c, m in IBAN_LENGTHS.items() if m == n) + rf")[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n in lengths)
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])"


IBAN = _iban()
SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"

#: Words that raise a span's score when they stand within NEAR characters before it.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|server|host",
    "card": "card|visa|credit|pay",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "secret": "token|secret|key|password|passwd|bearer",
}
NEAR = 40
#: Score of a proposal, of one with a valid checksum, the bonus for context, and the least score to be reported.
PROPOSED, CONFIRMED, NEARBY, LEAST = 0.4, 0.8, 0.3, 0.6
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret")
#: Members of a running sum that are added one by one; longer lists are summed in parts of this size.
PART = 200


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x pass the Luhn test: from the right, every second one doubled."""
    d = F.reverse(digits(x))
    doubled = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda n, i: n + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(
            (F.substr(d, i, F.lit(1)).cast("int") * 2) % 10 + F.when(F.substr(d, i, F.lit(1)) >= "5", 1).otherwise(0)
        ),
    )
    return F.when(F.length(d) > 0, doubled % 10 == 0).otherwise(False)


def mod97(x: Column) -> Column:
    """Whether an IBAN, its first four characters moved behind the rest and letters as 10 to 35, is 1 modulo 97."""
    plain = F.regexp_replace(x, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        F.lit(0),
        lambda r, c: F.when(c <= "9", (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _running(a: Column) -> Column:
    """Sums of the members before each one, parts at a time, so that long lists take no quadratic time."""
    def sums(part, base):
        step = lambda s, n: F.struct((s["sum"] + n).alias("sum"), F.concat(s["all"], F.array(s["sum"])).alias("all"))
        return F.aggregate(part, F.struct(base.alias("sum"), F.array().cast("array<int>").alias("all")), step)

    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(PART)), lambda i: F.slice(a, i + 1, F.lit(PART)))
    totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, n: s + n))
    bases = sums(totals, F.lit(0))["all"]
    return F.flatten(F.zip_with(parts, bases, lambda p, b: sums(p, b)["all"]))


def _proposals(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit, before) of the matches of a pattern, leftmost and apart; starts in code points.

    The gaps that a split leaves alternate with the matches, so running sums of both lengths give the places.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h))
    starts = _running(pairs)
    return F.transform(
        F.arrays_zip(hits.alias("hit"), gaps.alias("gap"), starts.alias("base")),
        lambda x: F.struct(
            (x["base"] + F.length(x["gap"])).alias("start"),
            (x["base"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"),
            x["hit"].alias("hit"),
            F.lower(F.right(x["gap"], F.lit(NEAR))).alias("before"),
        ),
    )


def _checked(kind: str, x: Column) -> tuple[Column, Column]:
    """Whether a proposal is valid at all, and whether a checksum confirms it."""
    hit, none = x["hit"], F.lit(False)
    if kind == "email":
        return F.lit(True), F.lit(True)
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$"), F.lit(True)
    if kind == "card":
        return F.length(digits(hit)).between(13, 19) & luhn(hit), F.lit(True)
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15), none
    if kind == "iban":
        return mod97(hit), F.lit(True)
    # a path has slashes too, but hardly ever capitals, small letters and digits at once
    mixed = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    return F.when(hit.rlike("[/+]"), mixed & hit.rlike("[a-z]") & hit.rlike("[A-Z]") & ~hit.startswith("/")).otherwise(mixed), none


def with_spans(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs and a column with its array of (kind, start, end, hit, score) by kind as in KINDS, then start.

    The base kinds are reported whenever their check holds. Of the others, a span whose checksum fails is
    never reported, and one without a checksum needs a score of LEAST: a context word before it. Null text
    counts as empty. docs must have no column p_<kind>.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # a cheap look for what every match of a kind holds decides whether its pattern runs at all
    needs = {"email": F.contains(t, F.lit("@")), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.contains(t, F.lit("+")), "iban": t.rlike("[A-Z]{2}[0-9]{2}"), "secret": t.rlike("[A-Za-z0-9+/_-]{20}")}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "secret": SECRET}
    empty = "array<struct<start:int,end:int,hit:string,before:string>>"
    rows = docs
    for kind in KINDS:
        rows = rows.withColumn(f"p_{kind}", F.when(needs[kind], _proposals(t, patterns[kind])).otherwise(F.array().cast(empty)))

    def scored(kind):
        def one(x):
            ok, sure = _checked(kind, x)
            score = F.when(sure, CONFIRMED).otherwise(PROPOSED) + F.when(x["before"].rlike(rf"\b(?:{CONTEXT[kind]})\b"), NEARBY).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), F.when(ok, F.least(score, F.lit(1.0))).alias("score"))

        least = 0.0 if kind in BASE else LEAST
        return F.filter(F.transform(f"p_{kind}", one), lambda s: s["score"] >= least)

    return rows.select(*docs.columns, F.concat(*(scored(k) for k in KINDS)).alias(name))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and found (see with_spans) for each row; ids that repeat or are missing make no difference."""
    return with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), "text", "found").drop("text")


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, found (any span) and score (the surest one's, 0 without) for each row.

    See with_spans() and find() for the odd cases.
    """
    def joined(keep):
        return F.array_join(F.transform(keep, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = find(docs, text)
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    surest = F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0))
    return found.select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_spans"), (F.size("found") > 0).alias("found"), surest.alias("score"),
    )


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the text with each reported span replaced by its kind in brackets.

    Each row is masked by its own spans, whatever its id. Spans of different kinds may overlap: they are
    replaced together under the kind that begins first. Null text becomes empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # a span inside what is covered already adds nothing; one that reaches beyond extends the cover
    step = lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.substr("text", s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]"))).alias("out"))
    got = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return with_spans(rows, "text", "found").withColumn("got", got).select("doc_id", F.concat("got.out", F.substr("text", F.col("got.at") + 1)).alias("text"))
