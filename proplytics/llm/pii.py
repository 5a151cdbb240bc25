"""Personal data and what gives it away, in DataFrame functions only.

Base spans (e-mail, IP, card, phone) are found by pattern in every whole text. Terms beside them can still name the person:
over all different texts, the co-occurrence of a term with a protected value, or with what the value shares with others (mail domain,
phone prefix), estimates how much of the value's information the term gives away, PMI(term; value) / IC(value), smoothed for
rare terms. Terms over one threshold are generalised to their first letters, over a higher one removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplytics.llm.common import compact, written

#: kinds in the order in which spans are listed
KINDS = ("email", "ip", "card", "phone", "term")
#: stand for a dot within a domain or local part, and for a separator between digits; they take the place of one character
DOT, GAP = "\u0003", "\u0001"
# each run is one character class and is taken whole, so no text makes these backtrack or recurse
EMAIL = f"(?:(?<![A-Za-z0-9._%+{DOT}-])|\\G)[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = f"(?<![0-9{GAP}])[0-9](?:{GAP}?+[0-9]){{15,18}}+(?![0-9{GAP}])"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
TERM = "\\p{L}++"

SPAN = "struct<kind:int,first:int,last:int,value:string>"


def located(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all matches: what lies between the matches gives their places, in code points."""
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                      lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))
    both = F.filter(both, lambda x: x["match"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + x["gap"]
        last = first + F.length(x["match"])
        span = F.struct(F.lit(kind).alias("kind"), first.alias("first"), last.alias("last"), x["match"].alias("value"))
        return F.struct(last.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.aggregate(both, start, step, lambda state: state["spans"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right counts double, less 9 if over 9."""

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _small_parts(value: Column) -> Column:
    return F.forall(F.split(value, "\\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def base_spans(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``text``) and ``spans``, the base spans by kind and place; null texts have none."""
    nothing = F.expr(f"cast(array() as array<{SPAN}>)")
    body = F.translate(F.coalesce("text", F.lit("")), DOT + GAP, "\u0002\u0002")  # in no pattern; same length
    rows = rows.withColumn("_body", body)
    dotted = F.regexp_replace("_body", "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])", DOT)
    joined = F.regexp_replace("_body", "(?<=[0-9])[\\x20-](?=[0-9])", GAP)
    rows = rows.withColumn("_dotted", F.when(F.contains("_body", F.lit("@")), dotted)).withColumn("_joined", F.when(F.col("_body").rlike("[0-9]"), joined))
    email = F.when(F.col("_dotted").isNotNull(), located(F.col("_dotted"), EMAIL, 0)).otherwise(nothing)
    ip = F.when(F.col("_joined").isNotNull(), F.filter(located(F.col("_body"), IP, 1), lambda s: _small_parts(s["value"]))).otherwise(nothing)
    card = F.when(F.col("_joined").isNotNull(), F.filter(located(F.col("_joined"), CARD, 2), lambda s: luhn(_digits(s["value"])))).otherwise(nothing)
    phone = F.filter(located(F.col("_body"), PHONE, 3), lambda s: F.length(_digits(s["value"])).between(8, 15))
    phone = F.when(F.contains("_body", F.lit("+")), phone).otherwise(nothing)
    return rows.withColumn("spans", F.concat(email, ip, card, phone)).drop("_body", "_dotted", "_joined")


def _listed(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["first"].cast("string"), s["last"].cast("string"))), ",")


def _entities(span: Column) -> Column:
    """What is protected: the value without the ways of writing it, and what it shares with other values of the person or the
    group: mail domain and words of the local part, network of an address, issuer of a card, phone number without its last four digits."""
    mail, digits = F.translate(F.lower(span["value"]), DOT, "."), _digits(span["value"])
    words = F.filter(F.split(F.substring_index(mail, "@", 1), "\\P{L}+"), lambda w: w != "")
    shared = F.when(span["kind"] == 0, F.concat(F.array(F.concat(F.lit("domain:"), F.substring_index(mail, "@", -1))), F.transform(words, lambda w: F.concat(F.lit("name:"), w))))
    shared = shared.when(span["kind"] == 1, F.array(F.concat(F.lit("net:"), F.substring_index(span["value"], ".", 3))))
    shared = shared.when(span["kind"] == 2, F.array(F.concat(F.lit("issuer:"), F.substring(digits, 1, 6))))
    shared = shared.otherwise(F.array(F.concat(F.lit("prefix:"), F.substring(digits, F.lit(1), F.length(digits) - 4))))
    value = F.when(span["kind"] == 0, mail).when(span["kind"] == 1, span["value"]).otherwise(digits)
    return F.array_union(F.array(F.concat_ws(":", span["kind"].cast("string"), value)), shared)


def terms_of(text: Column, least: int) -> Column:
    """Distinct lower-cased runs of ``least`` letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\P{L}+"), lambda w: F.length(w) >= least))


def disclosing_terms(rows: DataFrame, base: DataFrame, threshold: float, doubt: float, least: int) -> DataFrame:
    """(text_key, term, ratio) of the terms that give away a protected value, or what it shares with others, of their own text.

    Texts with the value count once each, however often they are copied: copies say nothing about what goes together. Documents
    without it count each. Of n_term texts with a term, n_both hold the value, of all texts the part p: the chance of the value
    beside the term is (n_both + doubt p) / (n_term + doubt), which draws rare terms towards p, and its log over p, divided by
    log(1 / p), is the share of information given away. One text is enough where the value is rare enough: with ``doubt`` 1 a
    term of one text alone gives away 1 - 1 / log2(texts) of its value.
    """
    texts = base.where(F.size("spans") > 0).groupBy("text_key").agg(F.count("*").alias("n"), F.min("row_key").alias("row_key"), F.any_value("spans").alias("spans"))
    texts = written(texts)
    spans = texts.select("text_key", "n", F.explode("spans").alias("span"))
    held = written(spans.select("text_key", "n", F.explode(_entities(F.col("span"))).alias("entity")).distinct())
    again = written(held.groupBy("entity").agg(F.count("*").alias("n_value"), F.sum("n").alias("rows")).where("n_value > 1"))
    # what one text alone shares with nobody says the same as its value
    held = held.join(again, "entity", "left").where(F.col("n_value").isNotNull() | F.col("entity").rlike("^[0-9]:"))
    held = held.withColumn("n_value", F.coalesce("n_value", F.lit(1))).withColumn("rows", F.coalesce("rows", "n"))
    p = F.col("n_value") / (F.lit(float(base.count())) - F.col("rows") + F.col("n_value"))
    # the most documents that a term may stand in, if the value stands beside it in all of its own
    most = F.floor((F.col("n_value") + doubt * p) / F.pow(p, F.lit(1 - threshold)) - doubt + 1e-6) + F.col("rows") - F.col("n_value")
    held = written(held.select("text_key", "n", "entity", p.alias("p"), most.alias("most")).where("p < 1"))
    bound = held.agg(F.max("most")).first()[0] or 0
    terms = F.explode(terms_of(F.col("text"), least)).alias("term")
    one_each = compact(texts.join(held.select("text_key").distinct(), "text_key", "left_semi").select("row_key", "text_key"))
    near = written(rows.join(one_each, "row_key").select("text_key", terms).distinct())
    everywhere = written(rows.select(terms).groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") <= bound))
    near = written(near.join(everywhere, "term"))
    beside = written(near.join(held, "text_key").where("n_term <= most"))
    told = beside.groupBy("entity", "term", "n_term", "p").agg(F.count("*").alias("n_both"), F.sum("n").alias("rows"))
    alone = F.col("n_term") - F.col("rows") + F.col("n_both")
    ratio = 1 - F.log((F.col("n_both") + doubt * F.col("p")) / (alone + doubt)) / F.log("p")
    told = written(told.select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= threshold))
    return beside.join(told, ["entity", "term"]).groupBy("text_key", "term").agg(F.max("ratio").alias("ratio"))


def sanitised(docs: DataFrame, generalise: float = 0.9, doubt: float = 1.0, least: int = 1,
              doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_key, base, spans, terms of every row: base spans, and all spans with those of disclosing terms.

    ``spans`` are structs (kind, first, last, value) by kind, then place; places are code points, the last one exclusive. Term
    spans carry the ratio in ``terms`` (first, last, ratio), stand outside base spans and never occur in documents without base spans. A null text
    is an empty one; equal rows get equal spans; empty tables give no rows. Values are told apart after case and separators are dropped.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[doc_id], docs[text]).alias("row_key"))
    base = written(base_spans(rows).select("doc_id", "row_key", F.xxhash64("text").alias("text_key"), "spans"))
    terms = disclosing_terms(rows, base, generalise, doubt, least)
    listed = written(terms.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "ratio"))).alias("ratios")))
    marked = written(base.where(F.size("spans") > 0).join(listed, "text_key").select("row_key", "spans", "ratios"))
    some = rows.join(compact(marked.dropDuplicates(["row_key"])), "row_key")
    words = F.filter(located(F.col("text"), TERM, 4), lambda s: F.map_contains_key("ratios", F.lower(s["value"])))
    outside = F.filter(words, lambda s: ~F.exists("spans", lambda b: (b["first"] < s["last"]) & (s["first"] < b["last"])))
    found = written(some.select("row_key", outside.alias("words"), "ratios").dropDuplicates(["row_key"]))
    found = found.select("row_key", "words", F.transform("words", lambda s: F.struct(
        s["first"].alias("first"), s["last"].alias("last"), F.element_at("ratios", F.lower(s["value"])).alias("ratio"))).alias("terms"))
    out = base.join(found, "row_key", "left")
    everything = F.concat("spans", F.coalesce("words", F.expr(f"cast(array() as array<{SPAN}>)")))
    return out.select("doc_id", "row_key", F.col("spans").alias("base"), everything.alias("spans"),
                      F.coalesce("terms", F.expr("cast(array() as array<struct<first:int,last:int,ratio:double>>)")).alias("terms"))


def clean_texts(docs: DataFrame, remove: float = 0.98, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with personal data taken out of the text: base spans become ``[EMAIL]`` and so on, terms over ``remove``
    become ``[TERM]``, other disclosing terms their first two letters (half of a shorter term) and a dash. Of spans that overlap the first is replaced."""
    found = sanitised(docs, doc_id=doc_id, text=text, **options)
    marked = found.withColumn("edits", F.concat(
        F.transform("base", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), F.concat(
            F.lit("["), F.upper(F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])), F.lit("]")).alias("to"))),
        F.transform("terms", lambda t: F.struct(t["first"].alias("first"), t["last"].alias("last"), F.when(t["ratio"] >= remove, F.lit("[TERM]")).alias("to"))),
    )).where(F.size("edits") > 0).select("row_key", F.array_sort("edits").alias("edits")).dropDuplicates(["row_key"])
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("row"), F.xxhash64(docs[doc_id], docs[text]).alias("row_key"), docs[text].alias("body"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, e: Column) -> Column:
        kept = F.substring("body", state["at"] + 1, e["first"] - state["at"])
        letters = F.least(F.lit(2), F.floor((e["last"] - e["first"]) / 2).cast("int"))
        general = F.concat(F.substring("body", e["first"] + 1, letters), F.lit("-"))
        edited = F.struct(e["last"].alias("at"), F.concat(state["out"], kept, F.coalesce(e["to"], general)).alias("out"))
        return F.when(e["first"] >= state["at"], edited).otherwise(state)

    whole = F.aggregate("edits", start, step, lambda s: F.concat(s["out"], F.substring("body", s["at"] + 1, F.length("body"))))
    out = packed.join(compact(marked), "row_key", "left").withColumn("cleaned", F.when(F.col("edits").isNull(), F.col("body")).otherwise(whole))
    return out.select(*[F.col("cleaned").alias(c) if c == text else F.col("row")[c].alias(c) for c in names])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans of the rows of ``sanitised``."""

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
                        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
