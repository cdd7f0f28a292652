"""Personal data in texts: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

Everything on the main path is a Spark SQL function. For every kind the text is cut once by its
pattern, into matches and the gaps between them (a mark is put around the matches and the text split there; a text that holds the mark itself is cut
twice, by `regexp_extract_all` and `split`), and running sums of both lengths
give exact code-point positions in time linear in the text. The patterns use possessive quantifiers and start
only at the beginning of a run (or where the last match ended), so that they need no backtracking and no
recursion on long runs, and match exactly what their plain forms match.
An account number ends after as many characters as its country has, so words that follow it are not taken for its last groups.
Credentials count as personal data: values that stand behind the name of a credential and look random, whatever stands behind `password:` or
`password=` and isn't a plain word, keys of well-known formats, and user names with passwords in addresses.

Defined results of find_spans: a null text counts as empty; repeated rows and repeated doc_ids each give a row; a null
doc_id is kept; an empty table gives an empty result; columns other than doc_id and text are ignored. Of mask: every span that find_spans()
reports is replaced, spans that overlap as one, by the kind of the first (of those that begin together, the kind listed first), and what then is a match; a null text
stays null; every row and every other column stays, whatever its name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE_KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    at = lambda i: F.substring(d, i + 1, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, doubled(at(i))).otherwise(at(i)))
    return F.length(d).between(13, 19) & (total % 10 == 0)


def _random(m: Column) -> Column:
    """Letters and digits, of ten kinds at least: what people write as a word, a number or a place-holder has fewer."""
    return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= 10)


def _uncommon(m: Column) -> Column:
    """Not letters alone, and with a letter."""
    return m.rlike(r"[^A-Za-z.!?)]") & m.rlike("[A-Za-z]")


def _mod97(m: Column) -> Column:
    """ISO 7064 mod 97-10 of an IBAN: its first four characters go to the end, letters count from 10."""
    s = F.regexp_replace(m, " ", "")
    s = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    code = lambda i: F.ascii(F.substring(s, i, F.lit(1)))
    step = lambda acc, i: F.when(code(i) >= 65, (acc * 100 + code(i) - 55) % 97).otherwise((acc * 10 + code(i) - 48) % 97)
    return F.length(s).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step) == 1)


@dataclass(frozen=True)
class Kind:
    """pattern: proposes; valid: confirms a match (a column function); start: score of a confirmed match;
    words: words nearby that raise its score by `raise_by`; needed: a cheap test a text must pass first."""

    name: str
    pattern: str
    valid: object
    needed: object
    start: float
    words: str
    raise_by: float = 0.3


#: Characters of an IBAN by country: the registry's, and those in use without being registered.
IBAN_LENGTHS = {
    n: codes.split()
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
        28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
_KNOWN = "|".join(c for codes in IBAN_LENGTHS.values() for c in codes)
# as many characters as the country has, whatever follows; or else a longest run that stops before another IBAN
_IBAN = "|".join(rf"(?:{'|'.join(codes)})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, codes in IBAN_LENGTHS.items())
_IBAN = rf"(?<![A-Za-z0-9])(?:{_IBAN}|[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20(?:{_KNOWN})[0-9]{{2}})\x20?+[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))"
_NAMES = "(?:api|access|secret|private|auth|client)[_-]?(?:key|token|secret)|secret|token|bearer|password|passwd|passwort|pwd"
_SET = r"['\x22]?(?:\x20{0,2}[:=]\x20{0,2}|\x20)['\x22]?"  # between a name and its value
_PASSWORD = r"(?i:password|passwd|passwort|passphrase|pwd|contrase\u00f1a|mot de passe)\x20{0,2}[:=]\x20{0,2}['\x22]?"
_KEYS = r"AKIA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,}+|xox[baprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), lambda t: F.contains(t, F.lit("@")), 0.7, "mail|contact|correo|courriel|kontakt"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), lambda t: t.rlike(r"[0-9]\.[0-9]"), 0.6, r"\bip\b|server|host|address|adresse"),
    Kind("card", r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?+[0-9])++", _luhn, lambda t: t.rlike("[0-9][ -]?[0-9]"), 0.6, "card|visa|credit|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), lambda t: F.contains(t, F.lit("+")), 0.6, "phone|tel|call|mobile|telefon"),
    Kind("iban", _IBAN, _mod97, lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), 0.7, "iban|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"), 0.3, r"\bssn\b|social security"),
    Kind("secret", rf"(?<=(?<![A-Za-z0-9])(?i:{_NAMES}){_SET})[A-Za-z0-9+/=_-]{{16,}}+", _random, lambda t: F.lower(t).rlike("token|secret|passw|pwd|bearer|key") & t.rlike(rf"(?i)(?:{_NAMES}){_SET}[A-Za-z0-9+/=_-]{{16}}"), 0.7, "token|key|secret"),
    Kind("key", rf"(?<![A-Za-z0-9])(?:{_KEYS})", lambda m: F.lit(True), lambda t: reduce(or_, [F.contains(t, F.lit(w)) for w in ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "sk-", "eyJ", "PRIVATE KEY")]), 0.7, "token|key|secret"),
    Kind("password", rf"(?<={_PASSWORD})[^\s\x22'<>,;]{{6,64}}+", _uncommon, lambda t: F.lower(t).rlike("pass(word|wd|wort|phrase)|pwd|contrase|mot de passe"), 0.7, "login|user|account|konto|compte|cuenta"),
    Kind("login", r"(?<=://)[^\s/:@]{1,64}+:[^\s/:@]{1,128}+(?=@)", lambda m: F.lit(True), lambda t: F.contains(t, F.lit("://")) & F.contains(t, F.lit("@")), 0.7, "http|ftp|sql"),
)
#: Added spans below this score are left out; base spans always stay.
LEAST_SCORE = 0.5
#: Code points on either side in which words count as nearby.
NEARBY = 40


#: A character that hardly any text holds; it is put around matches.
MARK = "\x01"


def _cut(text: Column, k: Kind) -> Column:
    """The text as gap, match, gap, ..., gap; one gap where k isn't found."""
    matches, gaps = F.regexp_extract_all(text, F.lit(k.pattern), 0), F.split(text, k.pattern, -1)
    pairs = F.flatten(F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), matches, lambda g, m: F.array(g, m)))
    twice = F.concat(pairs, F.slice(gaps, -1, 1))
    once = F.split(F.regexp_replace(text, F.lit(k.pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    return F.when(~k.needed(text), F.array(text)).when(F.contains(text, F.lit(MARK)), twice).otherwise(once)


def _proposed(parts: Column, k: Kind, order: int) -> Column:
    """Array of struct(kind, order, at, gap, length, valid, score): one for each match of k in a text cut by _cut(), in text order."""
    tail = lambda s: F.substring(s, -NEARBY, NEARBY)

    def of(i: Column) -> Column:
        m, before, after = F.get(parts, 2 * i + 1), F.get(parts, 2 * i), F.get(parts, 2 * i + 2)
        near = F.lower(F.concat(tail(before), F.lit(" "), F.substring(after, 1, NEARBY)))
        return F.struct(F.lit(k.name).alias("kind"), F.lit(order).alias("order"), i.alias("at"), F.char_length(before).cast("long").alias("gap"), F.char_length(m).cast("long").alias("length"), k.valid(m).alias("valid"), (F.lit(k.start) + F.when(near.rlike(k.words), k.raise_by).otherwise(0.0)).alias("score"))

    n = F.floor((F.size(parts) - 1) / 2).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), of)


def find_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """A row for each row of docs: doc_id and spans, an array of struct(order, start, end, kind, score) in that order.

    Spans are exploded without their texts, summed up in a window over the row, and gathered again; a group
    holds the spans of one text only."""
    text = F.coalesce(F.col("text"), F.lit(""))
    all_kinds = F.concat(*[_proposed(F.col(f"_{i}"), k, i) for i, k in enumerate(kinds)])
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", text.alias("_text")).select("_row", "doc_id", *[_cut(F.col("_text"), k).alias(f"_{i}") for i, k in enumerate(kinds)])
    rows = rows.select("_row", "doc_id", F.explode_outer(all_kinds).alias("s")).select("_row", "doc_id", "s.*")
    upto = "over (partition by _row, kind order by at rows between unbounded preceding and current row)"
    placed = rows.withColumn("end", F.expr(f"sum(gap + length) {upto}")).withColumn("start", F.col("end") - F.col("length"))
    keep = F.col("valid") & (F.col("kind").isin(*BASE_KINDS) | (F.col("score") >= LEAST_SCORE))
    return placed.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(keep, F.struct("order", "start", "end", "kind", F.round("score", 2).alias("score"))))).alias("spans")).drop("_row")


def _kept(k: Kind):
    return lambda s: s["valid"] & (F.lit(k.name in BASE_KINDS) | (s["score"] >= LEAST_SCORE))


def _replaced(parts: Column, spans: Column, k: Kind) -> Column:
    """The text with the matches of one kind replaced."""
    kept = _kept(k)
    return F.array_join(F.transform(parts, lambda p, i: F.when((i % 2 == 1) & kept(F.get(spans, F.floor(i / 2).cast("int"))), F.lit(f"[{k.name.upper()}]")).otherwise(p)), "")


def _marked(parts: Column, spans: Column, k: Kind, order: int) -> Column:
    """A character for each of the text's: the kind's letter where a match begins, 1 within it, 0 elsewhere."""
    kept, letter = _kept(k), chr(65 + order)
    lengths = lambda p: F.char_length(p)
    of = lambda p, i: F.when((i % 2 == 1) & kept(F.get(spans, F.floor(i / 2).cast("int"))), F.concat(F.lit(letter), F.repeat(F.lit("1"), lengths(p) - 1))).otherwise(F.repeat(F.lit("0"), lengths(p)))
    return F.split(F.array_join(F.transform(parts, of), ""), "", -1)


def mask(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with every span of find_spans() in text replaced by its kind in brackets, and n_chars set anew. All other columns stay.

    All kinds are sought in the text as it came. Where only one is found, its gaps and brackets are joined; where several are, the
    text goes character by character along the marks of all of them, so that spans that overlap become one. Texts that
    changed are gone through once more, for what a replaced neighbour kept from being a match."""
    columns, own = docs.columns, "_"
    while any(c.lower().startswith(f"{own}pii") for c in columns):
        own += "_"
    changed = f"{own}pii"
    docs = _masked(docs.withColumn(changed, F.lit(True)), kinds, changed)
    docs = _masked(docs, kinds, changed).drop(changed)
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else docs


def _masked(docs: DataFrame, kinds: tuple[Kind, ...], changed: str) -> DataFrame:
    """docs with texts masked where the column `changed` holds, and there whether anything was replaced."""
    text, at, n = F.col("text"), lambda what, i="": f"{changed}{what}{i}", range(len(kinds))
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", changed)]
    rows = docs.withColumns({at("parts", i): F.when(F.col(changed), _cut(text, k)).otherwise(F.array(text)) for i, k in enumerate(kinds)})
    rows = rows.withColumns({at("spans", i): _proposed(F.col(at("parts", i)), k, i) for i, k in enumerate(kinds)})
    rows = rows.withColumns({at("any", i): F.coalesce(F.exists(at("spans", i), _kept(k)), F.lit(False)) for i, k in enumerate(kinds)})
    found = sum((F.col(at("any", i)).cast("int") for i in n), F.lit(0))
    single = reduce(lambda other, i: F.when(F.col(at("any", i)), _replaced(F.col(at("parts", i)), F.col(at("spans", i)), kinds[i])).otherwise(other), n, text)
    inner = lambda a, b: F.when((a == "1") | (b == "1"), "1").when(a == "0", b).when(b == "0", a).otherwise(F.least(a, b))
    letters = F.split(text, "", -1)
    each = F.array(*[F.when(F.col(at("any", i)), _marked(F.col(at("parts", i)), F.col(at("spans", i)), k, i)) for i, k in enumerate(kinds)])
    marks = F.aggregate(F.array_compact(each), F.transform(letters, lambda c: F.lit("0")), lambda a, b: F.zip_with(a, b, inner))
    names = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (chr(65 + i), f"[{k.name.upper()}]")])
    rows = rows.withColumns({at("marks"): F.when(found > 1, marks), at("found"): found})
    several = F.array_join(F.zip_with(letters, F.col(at("marks")), lambda c, m: F.when(m == "0", c).when(m == "1", "").otherwise(names[m])), "")
    out = F.when(F.col(at("found")) == 0, text).when(F.col(at("found")) == 1, single).otherwise(several)
    rows = rows.withColumn(at("out"), out)
    return rows.select(*columns, F.col(at("out")).alias("text"), (F.col(at("found")) > 0).alias(changed)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))
