"""Personal data in texts by DataFrame operations alone: exact rules, and spans that boosted trees add to them.

Generators of high recall propose spans, which may overlap; the exact rules are among them. Boosted trees learn, from
format and context, which proposals the rules confirm. The features leave out what the rules decide by (checksums,
ranges, a leading plus), so a proposal that looks like confirmed ones in all else can pass a kind's threshold, which
is calibrated on documents that the trees have not seen.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.frames import KEY, beside, keyed
from strideframe.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# Possessive runs and a start where a run starts (or where the last span ended) keep the rules linear on any text.
RULES = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser generators, (kind, pattern).
PROPOSALS = (
    ("email", rf"(?<!{LOCAL}){LOCAL}++(?: ?[\[({{<] ?(?:at|AT|@) ?[\])}}>] ?| (?:at|AT) | ?@ ?){LABEL}++(?:(?: ?[\[({{<] ?(?:dot|DOT|\.) ?[\])}}>] ?| (?:dot|DOT) |\.){LABEL}++)++"),
    ("ip", r"(?<![0-9])[0-9]{1,3}+(?:(?: ?[\[(]\.[\])] ?| (?:dot|DOT) | ?\. ?)[0-9]{1,3}+){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[ ._/-]{0,2}+[0-9]){11,}+"),
    ("card", r"(?<![0-9])[0-9]{4}+([ .-]?+)[0-9]{4}+\1[0-9]{4}+\1[0-9]{2,7}+(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z])(?:\+|00)?[0-9(](?:[ ().\-/]{0,3}+[0-9]){6,}+"),
    ("phone", r"(?<![0-9])(?:\+?[0-9]{1,3}+[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
#: Words that announce a kind, and such that announce other numbers, in the 40 characters before a span.
CUES = (r"e-?mail|mailto|contact|write to", r"\bip\b|addr|host|server|client", r"card|visa|amex|credit|debit|payment", r"phone|\btel|call|mobile|\bcell|\bfax", r"token|key|hash|sha|\bid\b|uuid|order|isbn|version")
#: Features of a span, each a whole number up to its bound, so the trees learn from counts of equal vectors.
FEATURES = ("kind", "digits", "runs", "longest", "last", "letters", "dots", "dashes", "blanks", "brackets", "sign", "top", "previous", "next", "cue")
ROUNDS, DEPTH = 12, 4
#: Share of confirmed spans over a threshold, at least; spans with which a kind's threshold is found, at least.
PRECISION, ENOUGH = 0.98, 20


def _passes_luhn(digits: Column) -> Column:
    """The checksum of a string of digits: from the right, every second digit doubled, tens and ones added."""
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int") * (1 + (F.length(digits) - i) % 2)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _confirmed(kind: Column, hit: Column) -> Column:
    """Whether a match of a kind's rule holds."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.forall(F.split(hit, r"\."), lambda x: x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
        .when(kind == "card", F.when(F.length(digits).between(14, 19), _passes_luhn(digits)).otherwise(False))
        .otherwise(F.length(digits).between(10, 15))
    )


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, generator, kind, start, end (code points, end exclusive), hit, before, after: every match of every generator.

    A text is split at the matches, so a match starts where the gaps and matches before it end. Only lengths and the
    characters near a match leave the scan.
    """
    text = F.col("text")

    def matches(number: int, kind: str, pattern: str) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("size"), F.right(g, F.lit(40)).alias("before"), F.left(g, F.lit(4)).alias("after")))
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.struct(F.lit(number).alias("generator"), F.lit(kind).alias("kind"), F.when(text.rlike(pattern), F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))).alias("found"))

    every = [matches(i, kind, p) for i, (kind, p) in enumerate((*RULES.items(), *PROPOSALS))]
    rows = keyed(docs, id_col, text_col).select(*KEY, F.explode(F.array(*every)).alias("x")).where("x.found is not null")
    rows = rows.select(*KEY, "x.generator", "x.kind", F.posexplode("x.found").alias("place", "m")).select(*KEY, "generator", "kind", "place", "m.gap.*", "m.hit")
    # Repeated rows are one document; the matches of a document and generator meet in one exchange.
    rows = rows.repartition(*KEY, "generator").dropDuplicates([*KEY, "generator", "place"])
    order = Window.partitionBy(*KEY, "generator").orderBy("place")
    end = F.sum(F.col("size") + F.coalesce(F.length("hit"), F.lit(0))).over(order)
    placed = rows.withColumns({"end": end, "after": F.lead("after").over(order)}).where("hit is not null")
    return placed.select(*KEY, "generator", "kind", (F.col("end") - F.length("hit")).alias("start"), "end", "hit", "before", "after")


def _features() -> dict[str, Column]:
    hit, end = F.col("hit"), F.col("before")
    runs = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))
    left = lambda c, most: F.least(c, F.lit(most))
    count = lambda pattern: F.length(F.regexp_replace(hit, f"[^{pattern}]", ""))
    side = lambda c: (
        F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^\p{L}$"), 2).when(c.rlike("^[0-9]$"), 3).when(c.rlike("^[\"'=:]$"), 4).otherwise(5)
    )
    cue = F.lit(0)
    for i, words in enumerate(CUES):
        cue = F.when(F.lower(end).rlike(words), i + 1).otherwise(cue)
    sign = F.when(hit.contains("@"), F.when(hit.rlike(r"\s|[\[({<]"), 2).otherwise(1)).when(hit.rlike(r"(?i)\bat\b"), 3).otherwise(0)
    return {
        "kind": F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "digits": left(count("0-9"), 24), "runs": left(F.size(runs), 10),
        "longest": left(F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)), 20), "last": left(F.coalesce(F.length(F.get(runs, F.size(runs) - 1)), F.lit(0)), 12),
        "letters": left(F.floor(count("A-Za-z") / 3), 8), "dots": left(count("."), 6), "dashes": left(count("-"), 4), "blanks": left(count(" "), 4), "brackets": left(count("()"), 2),
        "sign": sign, "top": F.length(F.regexp_extract(F.right(hit, F.lit(8)), "([A-Za-z]*)$", 1)),
        "previous": side(F.right(end, F.lit(1))), "next": side(F.left(F.coalesce("after", F.lit("")), F.lit(1))), "cue": cue,
    }


def candidates(found: DataFrame) -> DataFrame:
    """Each distinct span of a kind once: doc_id, h, kind, start, end, base (a rule confirms it), free (no base span overlaps it), the features (`f_` and their names)."""
    rules = F.col("generator") < len(RULES)
    spans = found.withColumn("base", F.when(rules, _confirmed(F.col("kind"), F.col("hit"))).otherwise(False))
    features = {f"f_{k}": c.cast("int") for k, c in _features().items()}
    one = spans.withColumns(features).groupBy(*KEY, "kind", "start", "end").agg(F.max("base").alias("base"), *[F.first(k).alias(k) for k in features])
    at = Window.partitionBy(*KEY).orderBy("start", "end", "kind")
    until = F.max(F.when(F.col("base"), F.col("end"))).over(at.rowsBetween(Window.unboundedPreceding, -1))
    onward = F.min(F.when(F.col("base"), F.col("start"))).over(at.rowsBetween(1, Window.unboundedFollowing))
    hidden = F.coalesce(until > F.col("start"), F.lit(False)) | F.coalesce(onward < F.col("end"), F.lit(False))
    return one.withColumn("free", ~F.col("base") & ~hidden)


def scored(spans: DataFrame) -> DataFrame:
    """`candidates` with p, the trees' probability that a span is of those the rules confirm; null without spans of both sorts to learn from.

    Four in five documents are learnt from, by the hash of the text. Equal vectors of features are counted first, so the
    rows of the fit are bounded by the features' bounds, not by the corpus.
    """
    names = [f"f_{k}" for k in FEATURES]
    teach = spans.where("(base or free) and pmod(h, 5) <> 0")
    cells = cut_lineage(teach.groupBy(*names, F.col("base").cast("double").alias("label")).agg(F.count("*").cast("double").alias("weight")))
    if cells.select("label").distinct().count() < 2:
        return spans.withColumn("p", F.lit(None).cast("double"))
    together = VectorAssembler(inputCols=names, outputCol="vector")
    trees = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, maxBins=32, seed=7)
    # Ordered, so that the same counts give the same trees.
    model = trees.fit(together.transform(cells.orderBy(*names, "label").coalesce(1)))
    return model.transform(together.transform(spans)).withColumn("p", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")


def thresholds(spans: DataFrame, precision: float = PRECISION) -> DataFrame:
    """kind, least: the lowest probability, in steps of 1/1000, from which on the share of confirmed spans in unseen documents stays at `precision` or above; one row for each kind that has one."""
    step = F.floor(F.col("p") * 1000).alias("step")
    seen = spans.where("(base or free) and pmod(h, 5) = 0 and p is not null").groupBy("kind", step).agg(F.sum(F.col("base").cast("long")).alias("good"), F.count("*").alias("n"))
    down = Window.partitionBy("kind").orderBy(F.desc("step"))
    share = seen.select("kind", "step", F.sum("good").over(down).alias("good"), F.sum("n").over(down).alias("n"))
    failed = share.where(F.col("good") < precision * F.col("n")).groupBy("kind").agg(F.max("step").alias("failed"))
    fine = share.join(failed, "kind", "left").where(F.col("step") > F.coalesce("failed", F.lit(-1)))
    return fine.groupBy("kind").agg((F.min("step") / 1000).alias("least"), F.max("good").alias("good")).where(F.col("good") >= ENOUGH).drop("good")


def find_spans(docs: DataFrame, precision: float = PRECISION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, kind, start, end, base, p: the spans of the rules, and those that the trees add.

    An added span overlaps no span of the rules, and of proposals that overlap in a chain the likeliest alone is added
    (ties: the longest, the first).
    """
    spans = cut_lineage(scored(cut_lineage(candidates(proposals(docs, id_col, text_col)))))
    likely = spans.where("free").join(thresholds(spans, precision), "kind").where(F.col("p") >= F.col("least"))
    at = Window.partitionBy(*KEY).orderBy("start", "end", "kind")
    until = F.max("end").over(at.rowsBetween(Window.unboundedPreceding, -1))
    chain = F.sum(F.when(until > F.col("start"), 0).otherwise(1)).over(at)
    best = Window.partitionBy(*KEY, "chain").orderBy(F.desc("p"), F.desc(F.col("end") - F.col("start")), "start", "kind")
    added = likely.withColumn("chain", chain).withColumn("place", F.row_number().over(best)).where("place = 1")
    columns = [*KEY, "kind", "start", "end", "base", "p"]
    return spans.where("base").select(*columns).unionByName(added.select(*columns))


def report(docs: DataFrame, precision: float = PRECISION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, h, n_email, n_ip, n_card, n_phone (spans of the rules), base_sha256, spans (of rules and trees, `kind:start:end` by start, then kind, then end).

    Null and empty texts have no spans; repeated rows get the same result each; spans of different kinds may overlap; a
    corpus without spans to learn from gets the rules' spans alone, and an empty table gives no rows. Texts of any length
    are scanned whole, in time linear in their length. Further columns, whatever their names, are left out.
    """
    name = F.concat_ws(":", "kind", "start", "end")
    order = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("kind"), "end", name.alias("name"), "base")
    listed = F.sort_array(F.collect_list(order))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    per = find_spans(docs, precision, id_col, text_col).groupBy(*KEY).agg(*[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS], listed.alias("all"))
    per = per.select(*KEY, *[f"n_{k}" for k in KINDS], F.sha2(text(F.filter("all", lambda x: x["base"])), 256).alias("base_sha256"), text(F.col("all")).alias("spans"))
    rows = beside(keyed(docs, id_col, text_col).select(*KEY), per)
    none = {**{f"n_{k}": F.lit(0).cast("long") for k in KINDS}, "base_sha256": F.sha2(F.lit("").cast("binary"), 256), "spans": F.lit("")}
    return rows.select(*KEY, *[F.coalesce(k, v).alias(k) for k, v in none.items()])


def redact(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, text with every stretch of `spans` (as of `find_spans`) replaced by `[KIND]`, that of its first span where spans overlap; null texts are empty."""
    at = Window.partitionBy(*KEY).orderBy("start", "end", "kind")
    until = F.max("end").over(at.rowsBetween(Window.unboundedPreceding, -1))
    chain = F.sum(F.when(until > F.col("start"), 0).otherwise(1)).over(at)
    first = F.min_by("kind", F.struct("start", "end", "kind"))
    merged = spans.withColumn("chain", chain).groupBy(*KEY, "chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), first.alias("kind"))
    before = Window.partitionBy(*KEY).orderBy("start")
    cut = merged.withColumn("from", F.coalesce(F.lag("end").over(before), F.lit(0)))
    per = cut.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "from", "end", "kind"))).alias("cuts"))
    rows = beside(keyed(docs, id_col, text_col), per)
    piece = lambda x: F.concat(F.substring("text", x["from"].cast("int") + 1, (x["start"] - x["from"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]"))
    rest = F.substring("text", F.element_at("cuts", -1)["end"].cast("int") + 1, F.length("text"))
    return rows.select(*KEY, F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("cuts", piece), ""), rest)).alias("text"))
