"""Personal data, and terms that disclose it, by information content. DataFrame functions only.

Base spans are found by pattern. Each distinct value found is a protected entity c, and so are its generalisations: the
part of it that other values share (a mail address's domain, say), and its kind. Over all documents, a term t (any word)
that occurs with it discloses PMI(t; c) = ln(p(t, c) / (p(t) p(c))) of the IC(c) = -ln p(c) there is to know about it. Where
PMI / IC reaches ``DISCLOSURE`` on ``SUPPORT`` distinct texts at least, the term's occurrences in documents with that
entity are spans too; ``sanitise`` generalises them to a label, and removes those that disclose everything.

PMI / IC of d needs p(c | t) >= p(c) ** (1 - d), so that of n documents at most n(c) ** d * n ** (1 - d) can have t. Terms
that more have, and entities and terms on too few texts, go before a text's entities meet its terms.

All that is found depends on a row's text alone, so tables are keyed by the text's hash, and equal texts are worked on once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmotif.session import materialise

DISCLOSURE, SUPPORT = 0.9, 3

# Fixed patterns. Possessive, and held to the start of a run (or the end of the last match), they find what the plain
# ones find, without going back over long runs.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Texts that don't match this have no span of the kind.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"0-9a-z\x{80}-\x{10FFFF}"

SPAN = "struct<start:int,end:int,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Doubling each second digit from the right; a digit that passes 9 counts 9 less."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - k) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def positions(text: Column, pattern: Column) -> Column:
    """start, end and value of each match: matches, and what stands between them, give the places by their lengths."""
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["b"])
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("out"))

    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    return F.aggregate(pairs, start, add)["out"]


def base_spans(text: Column, kind: str) -> Column:
    """The valid spans of one kind, by start."""
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(HINTS[kind]), F.filter(positions(text, F.lit(KINDS[kind])), lambda x: _valid(kind, x["value"]))).otherwise(none)


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


# Of a value in its plain form, the part that others share: a mail address's domain, an IP address's first three numbers,
# a card's issuer, a phone number without its last four digits.
SHARED = {"email": r"@(.*)$", "ip": r"^(.*)\.", "card": r"^(.{6})", "phone": r"^(.*).{4}$"}


def _entities(kind: str) -> Column:
    """Each value, the part of it that others share, a mail address's name, and the kind itself."""
    value = lambda x: F.lower(x["value"]) if kind in ("email", "ip") else _digits(x["value"])
    values = F.transform(kind, value)
    out = [F.transform(values, lambda v: F.concat(F.lit(f"{kind}:"), v)), F.transform(values, lambda v: F.concat(F.lit(f"{kind} of:"), F.regexp_extract(v, SHARED[kind], 1)))]
    if kind == "email":
        out.append(F.transform(values, lambda v: F.concat(F.lit("email name:"), F.substring_index(v, "@", 1))))
    return F.concat(*out, F.transform(F.slice(kind, 1, 1), lambda x: F.lit(kind)))


def _bare(text: Column) -> Column:
    """The text without its base spans."""
    every = F.array_sort(F.concat(*(F.transform(base_spans(text, k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(s: Column, x: Column) -> Column:
        part = F.when(x["start"] > s["at"], F.substring(text, s["at"] + 1, x["start"] - s["at"])).otherwise("")
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], part, F.lit(" ")).alias("out"))

    done = F.aggregate(every, start, cut)
    return F.when(F.size(every) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def _terms(text: Column) -> Column:
    """Distinct words beside the base spans; A-Z count as a-z."""
    hinted = F.greatest(*(text.rlike(h) for h in HINTS.values()))
    words = F.split(F.translate(F.when(hinted, _bare(text)).otherwise(text), UPPER, LOWER), rf"[^{_TERM}]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def disclosures(df: DataFrame, private: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(entity, term, share) of what discloses enough, and the (key, entity, term) it was looked for in.

    ``private`` has the distinct texts with base spans: key, rows, entities, terms. Counts are over all rows of ``df``."""
    n = df.count()
    held = materialise(private.select("key", "rows", F.explode("entities").alias("entity")), "pii-entities")
    entities = materialise(held.groupBy("entity").agg(F.sum("rows").alias("with_entity"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts"), "pii-counts")
    limit = lambda c: F.pow(F.col(c).cast("double"), disclosure) * float(max(n, 1)) ** (1 - disclosure) + 1e-6
    most = entities.agg(F.max(limit("with_entity"))).first()[0] or 0.0
    every = df.where("text is not null").select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    terms = every.where((F.col("with_term") >= support) & (F.col("with_term") <= most))
    found = private.select("key", F.explode("terms").alias("term")).join(terms, "term")
    found = found.groupBy("key").agg(F.collect_list(F.struct("term", "with_term")).alias("terms"))
    own = held.join(entities, "entity").groupBy("key", "rows").agg(F.collect_list(F.struct("entity", "with_entity", limit("with_entity").alias("limit"))).alias("entities"))
    pairs = own.join(found, "key").select("key", "rows", F.explode("entities").alias("e"), "terms")
    pairs = pairs.select("key", "rows", "e", F.explode(F.filter("terms", lambda t: t["with_term"] <= F.col("e.limit"))).alias("t"))
    pairs = materialise(pairs.select("key", "rows", "e.entity", "e.with_entity", "t.term", "t.with_term"), "pii-pairs")
    together = pairs.groupBy("entity", "term").agg(F.sum("rows").alias("both"), F.count("*").alias("texts"), F.first("with_entity").alias("with_entity"), F.first("with_term").alias("with_term"))
    pmi = F.log(F.col("both").cast("double") * n / (F.col("with_term").cast("double") * F.col("with_entity").cast("double")))
    share = F.when(F.col("with_entity") < n, pmi / F.log(F.lit(float(n)) / F.col("with_entity").cast("double")))
    told = together.where(F.col("texts") >= support).select("entity", "term", F.least(share, F.lit(1.0)).alias("share")).where(F.col("share") >= disclosure - 1e-9)
    return told, pairs.select("key", "entity", "term")


def find(df: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """Rows of doc_id, text (only where there are spans), arrays email, ip, card, phone of spans, and terms of
    struct<start,end,value,share,of>: what the term discloses of an entity in that document, at most 1, and the kind of the
    entity that it discloses most of.

    Null text counts as empty; repeated rows give repeated rows; a null doc_id stays null; other columns are left out.
    """
    df = df.select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select("doc_id", text.alias("text")).select("doc_id", "text", *(base_spans(F.col("text"), k).alias(k) for k in KINDS))
    some = F.greatest(*(F.size(k) for k in KINDS)) > 0
    rows = materialise(rows.select("doc_id", F.when(some, F.col("text")).alias("text"), F.when(some, F.md5("text")).alias("key"), *KINDS), "pii")
    none = F.array().cast("array<struct<start:int,end:int,value:string,share:double,of:string>>")
    plain = rows.where("key is null").select("doc_id", "text", *KINDS, none.alias("terms"))
    private = rows.where("key is not null")

    distinct = private.groupBy("key").agg(F.count("*").alias("rows"), F.first("text").alias("text"), *(F.first(k).alias(k) for k in KINDS))
    distinct = materialise(distinct.select("key", "rows", "text", F.array_distinct(F.concat(*(_entities(k) for k in KINDS))).alias("entities"), _terms(F.col("text")).alias("terms")), "pii-texts")
    told, pairs = disclosures(df, distinct, disclosure, support)
    kind = F.regexp_extract("entity", "^[a-z]+", 0).alias("of")
    in_text = pairs.join(told, ["entity", "term"]).groupBy("key", "term").agg(F.max(F.struct("share", kind)).alias("most"))
    in_text = in_text.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", "most"))).alias("told"))

    lower = F.translate("text", UPPER, LOWER)
    any_term = F.concat(F.lit(rf"(?<![{_TERM}])(?:"), F.array_join(F.transform("told", lambda x: x["term"]), "|"), F.lit(rf")(?![{_TERM}])"))
    shares = F.map_from_entries("told")
    spans = distinct.select("key", "text").join(in_text, "key").select("key", F.transform(positions(lower, any_term), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.element_at(shares, x["value"])["share"].alias("share"), F.element_at(shares, x["value"])["of"].alias("of"))).alias("terms"))
    return plain.unionByName(private.join(spans, "key", "left").select("doc_id", "text", *KINDS, F.coalesce("terms", none).alias("terms")))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, and all spans: base ones as listed, then terms."""
    found = find(df)
    base = F.concat(*(_named(k, F.col(k)) for k in KINDS))
    spans = F.array_join(F.concat(base, _named("term", F.col("terms"))), ",")
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), spans.alias("spans"))


def sanitise(df: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id and clean text: base spans become [KIND], terms [KIND TERM], the kind of what they disclose most of, or
    nothing where they disclose an entity wholly. Any word can be a term, words like "at" too, where it goes with an entity.

    Texts without spans stay as they are (null becomes empty). Of overlapping spans the first, then the longest, counts.
    """
    found = find(df, disclosure, support)
    label = lambda k: lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("e"), F.lit(f"[{k.upper()}]").alias("to"))
    term = lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("e"), F.when(x["share"] >= 1, "").otherwise(F.concat(F.lit("["), F.upper(x["of"]), F.lit(" TERM]"))).alias("to"))
    every = F.array_sort(F.concat(*(F.transform(k, label(k)) for k in KINDS), F.transform("terms", term)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(s: Column, x: Column) -> Column:
        return F.when(x["start"] < s["at"], s).otherwise(F.struct((-x["e"]).alias("at"), F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), x["to"]).alias("out")))

    done = F.aggregate(every, start, add)
    clean = F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))
    some = found.where("text is not null").select("doc_id", clean.alias("text"))
    size = F.greatest(*(F.size(base_spans(F.col("text"), k)) for k in KINDS))
    rest = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(size == 0)
    return some.unionByName(rest)
