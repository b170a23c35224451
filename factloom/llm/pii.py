"""Personal data by proposed spans, checksums and context, in SQL functions only.

A regular expression of each kind proposes spans; validators confirm them (Luhn for cards, mod-97 for
account numbers, value ranges for addresses, digit counts for phones); words nearby raise the score. Spans
of the four base kinds stay whatever their score; the other kinds stay from `MIN_SCORE` on.

How spans are located: matches are set between marker characters, the text is split at these, and running sums
of the pieces' lengths, taken in blocks, are the places. The words nearby are cut from the neighbouring pieces, so the work
grows with the text and not with its square. Markers that the text itself has are replaced by another
control character first, which no pattern distinguishes from them. Patterns use possessive quantifiers, so
long runs of digits or letters take linear time.

Defined results: a null or empty text has no spans; positions count code points from 0, ends exclusive; of spans that start
together the kind listed first comes first; repeated rows give the same spans; an empty table gives an empty result;
extra columns are kept by `detect`, except that one named as its output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MIN_SCORE = 0.5
NEAR = 40
#: A fold copies at most so many entries; matches have five characters or more, so so many pieces beside one hold NEAR characters.
BLOCK, BESIDE = 64, 18
SPANS = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"

LOCAL = r"[A-Za-z0-9._%+-]"
#: Kind: pattern, cheap necessary test (a substring, or a pattern after "~"), score when confirmed, context words. Fixed values.
KINDS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|kontakt|correo|courriel"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"~[0-9]\.[0-9]", 0.7, "(^|[^a-z0-9_])ip([^a-z0-9_]|$)|host|server|address|adresse"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "~(?:[0-9][ -]?){13}[0-9]", 0.8, "card|visa|master|karte|tarjeta|carte"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "~[A-Z]{2}[0-9]{2}", 0.8, "iban|bank|account|konto|cuenta|compte"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "~[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, "(^|[^a-z0-9_])ssn([^a-z0-9_]|$)|social security|tax id"),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT_BONUS = 0.3


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(number)
    value = lambda i: F.when(i % 2 == 1, F.substr(back, i, F.lit(1))).otherwise(F.translate(F.substr(back, i, F.lit(1)), "0123456789", "0246813579"))
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda acc, i: acc + value(i).cast("int")) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks leaves 1 modulo 97, letters counting from 10."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    step = lambda acc, c: F.when(c.between("0", "9"), acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return mod97(F.translate(match, " ", ""))
    return F.lit(True)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(sizes: Column, levels: int = 3) -> Column:
    """The sum of the entries before each one. A fold copies what it has gathered at every step, so it only runs over
    blocks of BLOCK entries; the blocks' sums are summed up in the same way."""

    def fold(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")))

    if levels == 1:
        return fold(sizes)["out"]

    def shifted(blocks: Column) -> Column:
        before = running(F.transform(blocks, lambda b: b["sum"]), levels - 1)
        return let(before, lambda at: F.flatten(F.transform(blocks, lambda b, i: F.transform(b["out"], lambda n: n + F.get(at, i)))))

    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: fold(F.slice(x, k * BLOCK + 1, BLOCK)))
    return let(sizes, lambda x: let(cut(x), shifted))


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: array<struct<start, ord, end, kind, score>>."""
    pattern, need, score, near = KINDS[kind]
    clean = F.translate(text, "\x01", "\x02")
    pieces = F.split(F.regexp_replace(clean, pattern, "\x01$0\x01"), "\x01", -1)

    def located(p: Column) -> Column:
        """Matches (every second piece) with their places and the characters around them, cut from the pieces nearby."""
        sizes, ends, heads = F.transform(p, lambda x: F.char_length(x)), F.transform(p, lambda x: F.right(x, F.lit(NEAR))), F.transform(p, lambda x: F.left(x, F.lit(NEAR)))

        def one(i: Column, at: Column, ends: Column, heads: Column) -> Column:
            before = F.array_join(F.slice(ends, F.greatest(i - BESIDE, F.lit(0)) + 1, F.least(i, F.lit(BESIDE))), "")
            after = F.array_join(F.slice(heads, i + 2, BESIDE), "")
            return F.struct(F.get(at, i).alias("s"), F.get(p, i).alias("m"), F.right(before, F.lit(NEAR)).alias("before"), F.left(after, F.lit(NEAR)).alias("after"))

        places = F.sequence(F.lit(1), F.size(p) - 1, F.lit(2))
        return let(running(sizes), lambda at: let(ends, lambda e: let(heads, lambda h: F.transform(places, lambda i: one(i, at, e, h)))))

    def scored(x: Column) -> Column:
        around = F.lower(F.concat(x["before"], x["m"], x["after"]))
        bonus = F.when(around.rlike(near), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(
            x["s"].alias("start"), F.lit(list(KINDS).index(kind)).alias("ord"), (x["s"] + F.char_length(x["m"])).alias("end"),
            F.lit(kind).alias("kind"), F.least(F.lit(score) + bonus, F.lit(1.0)).alias("score"),
        )

    none = F.array().cast(SPANS)
    found = lambda p: F.transform(F.filter(located(p), lambda x: confirmed(kind, x["m"])), scored).cast(SPANS)
    out = let(pieces, lambda p: F.when(F.size(p) > 1, found(p)).otherwise(none))
    if kind not in BASE:
        out = F.filter(out, lambda x: x["score"] >= MIN_SCORE)
    test = text.rlike(need[1:]) if need[0] == "~" else F.contains(text, F.lit(need))
    return F.when(test, out).otherwise(none)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def detect(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """df with `out`: all spans of a row, sorted by start and kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(out, F.array_sort(F.concat(*(spans_of(whole, k) for k in KINDS))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(shared.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii")
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.round(F.array_max(F.transform("pii", lambda x: x["score"])), 3).alias("top_score"))


def oracle() -> str:
    """The same in DuckDB, whose patterns have neither look-around nor possessive quantifiers: runs of letters and digits are set
    between marks (\\x03, \\x04) for account numbers, and a social security number is a whole run of digits and hyphens."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"\x03[A-Z]{2}[0-9]{2}(?:(?:\x04 \x03)?[A-Z0-9]){11,30}\x04", "ssn": r"[0-9-]+",
    }
    kinds = ", ".join(f"({i}, '{k}', {KINDS[k][2]}, '{KINDS[k][3]}', {k in BASE})" for i, k in enumerate(KINDS))
    source = {"iban": r"regexp_replace(text, '([A-Za-z0-9]+)', chr(3) || '\1' || chr(4), 'g')"}
    pieces = " UNION ALL ".join(f"SELECT r, {i} AS ord, string_split(regexp_replace({source.get(k, 'text')}, '{plain[k]}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS ps FROM d" for i, k in enumerate(KINDS))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(1) || chr(3) || chr(4), chr(2) || chr(2) || chr(2)) AS text FROM documents
), kinds(ord, kind, score, near, base) AS (VALUES {kinds}
), pieces AS ({pieces}
), one AS (
  SELECT r, ord, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM pieces WHERE len(ps) > 1
), plain AS (
  SELECT r, ord, i, translate(p, chr(3) || chr(4), '') AS p FROM one
), placed AS (
  SELECT r, ord, i, p AS m, (sum(length(p)) OVER (PARTITION BY r, ord ORDER BY i) - length(p))::BIGINT AS s FROM plain
), match AS (
  SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS dg, replace(m, ' ', '') AS acc FROM placed WHERE i % 2 = 0
), valid AS (
  SELECT m.*, k.kind, k.score, k.near, k.base, s + length(m) AS e, d.doc_id, d.text FROM match m JOIN kinds k USING (ord) JOIN d USING (r)
  WHERE CASE k.kind
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: coalesce(try_cast(p AS INT), 256) > 255)) = 0
    WHEN 'card' THEN length(dg) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(dg)), lambda j:
         CASE WHEN j % 2 = 0 THEN substr(dg, length(dg) - j, 1)::INT ELSE substr('0246813579', substr(dg, length(dg) - j, 1)::INT + 1, 1)::INT END)) % 10 = 0
    WHEN 'phone' THEN length(dg) BETWEEN 10 AND 15
    WHEN 'iban' THEN list_reduce(list_transform(range(length(acc)), lambda j: ord(substr(acc, (j + 4) % length(acc) + 1, 1))),
         lambda a, c: CASE WHEN c BETWEEN 48 AND 57 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END, 0) = 1
    WHEN 'ssn' THEN regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}')
    ELSE true END
), scored AS (
  SELECT r, ord, kind, base, s, e, least(1.0, score + CASE WHEN regexp_matches(lower(substr(text, greatest(s - {NEAR}, 0) + 1, least(s, {NEAR})) || m || substr(text, e + 1, {NEAR})), near)
         THEN {CONTEXT_BONUS} ELSE 0 END)::DOUBLE AS score FROM valid
), kept AS (
  SELECT *, kind || ':' || s || ':' || e AS span FROM scored WHERE base OR score >= {MIN_SCORE}
)
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in BASE)},
       sha256(coalesce(string_agg(span, ',' ORDER BY s, ord) FILTER (base), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, ord), '') AS spans, round(max(score), 3) AS top_score
FROM d LEFT JOIN kept USING (r) GROUP BY r, doc_id
"""
