"""Personal data by bootstrapped contextual extraction (operator 2), in DataFrame functions alone.

Regular expressions find base spans of four kinds. Each is a seed instance; tokens that look like identifiers (they hold
a digit) and lie in no base span are further instances, and those with the shape of a known kind of secret are seeds too. The
words around an instance are its lexical patterns. In each round a pattern's confidence is the mean score of its distinct
instances, and an instance's score is the confidence of its best trusted pattern. A pattern is trusted if it has confidence,
support by seeds alone, and if its phrase, wherever it occurs in the corpus, mostly stands beside an instance: "token =" may be,
"went to" is not. Trusted patterns of the last round add the spans of the identifiers that they stand beside, secrets
included: a shape alone adds no span, nor does the word behind an identifier, which only helps to score it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._common import cut, discard

KINDS = ("email", "ip", "card", "phone")
#: The kind of added spans.
ADDED = "id"
LOCAL = "[A-Za-z0-9._%+-]"
#: Matches equal those of the contract's patterns; possessive loops and starts at the edge of a run keep them linear.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",  # of runs with fewer digits none is a card
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text holds at least if it has a match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Characters that end an identifier besides white space, as in token="..." or (no. 12345).
ENDS = r"\s\"'`=<>(){}\[\],;|"
IDENTIFIER = rf"(?<![^{ENDS}])(?=[^{ENDS}]{{6}})[^{ENDS}0-9]*+[0-9][^{ENDS}]*+"
#: Shapes of secrets: hexadecimal digests and keys, and published forms of access keys and tokens.
SECRETS = (
    "(?=[0-9]*+[a-f])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})", "A(?:KIA|SIA)[0-9A-Z]{16}", "gh[opsu]_[A-Za-z0-9]{36}", "xox[abprs]-[A-Za-z0-9-]{10,}",
    "[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]{35}",
)
SECRET = f"^(?:{'|'.join(SECRETS)})$"
#: Characters of an identifier without the punctuation around it, and of its contexts.
LEAST, LEFT, RIGHT = 6, 60, 40
ROUNDS = 3
SUPPORT, CONFIDENCE = 3.0, 0.5
#: Least share of a pattern's distinct instances that are seeds, and of the occurrences of its phrase that stand beside an instance.
SEEDED, SPECIFIC = 0.25, 0.6
STRETCH = 256
SPAN = "array<struct<start:int,kind:int,end:int>>"
SEED = "array<struct<start:int,kind:int,end:int,instance:bigint>>"
#: Contexts are read from pieces of so many characters, so that their cost follows the text's length and not length x spans.
PIECE = 256


def found(text: Column, pattern: str) -> Column:
    """Matches with their places: array of (start, end, m)."""
    pieces = F.split(text, pattern, -1)
    zipped = F.arrays_zip(pieces.alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,m:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    def placed(z: Column) -> Column:  # by stretches, so that the cost of appending doesn't grow with the square of the matches
        def stretch(acc: Column, c: Column) -> Column:
            begin = F.struct(acc["at"].alias("at"), empty.alias("out"))
            return F.aggregate(F.slice(z, c * STRETCH + 1, F.lit(STRETCH)), begin, step, lambda own: F.struct(own["at"].alias("at"), F.concat(acc["out"], F.array(own["out"])).alias("out")))

        begin = F.struct(F.lit(0).alias("at"), F.array(empty).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / STRETCH).cast("int")), begin, stretch, lambda acc: F.flatten(acc["out"]))

    return F.flatten(F.transform(F.array(zipped), placed))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def holds(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    return {
        "email": F.lit(True),
        "ip": m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
        "card": n.between(14, 19) & luhn(digits(m)),
        "phone": n.between(10, 15),
    }[kind]


def seeds(text: Column) -> Column:
    """array of (start, kind number, end, instance) of the base spans, by start and then kind."""

    def of(k: int, kind: str) -> Column:
        matches = F.filter(found(text, PATTERNS[kind]), lambda x: holds(kind, x["m"]))
        spans = F.transform(matches, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), F.xxhash64(F.lower(x["m"])).alias("instance")))
        return F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.expr(f"cast(array() as {SEED})"))

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(x) for x in (*KINDS, ADDED)))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < end) & (b["end"] > start))


def words(text: Column) -> Column:
    """Lower-cased words of a context without the punctuation around them, digits as 0."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"[^\s\p{L}\p{M}\p{N}]++(?=\s|$)|(?<=^|\s)[^\s\p{L}\p{M}\p{N}]++", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def before(pieces: Column, at: Column) -> Column:
    """The LEFT characters in front of a place in the text that ``pieces`` are cut from."""
    k = F.floor(at / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, k - 1), F.lit("")), F.coalesce(F.get(pieces, k), F.lit("")))
    end = at - F.greatest(k - 1, F.lit(0)) * PIECE
    return F.substring(two, F.greatest(end - LEFT, F.lit(0)) + 1, F.least(end, F.lit(LEFT)))


def after(pieces: Column, at: Column) -> Column:
    """The RIGHT characters from a place on."""
    k = F.floor(at / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
    return F.substring(two, at - k * PIECE + 1, F.lit(RIGHT))


def read_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base and the instances of each row (text null: empty): its base spans, and the identifiers outside them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    core = r"[\p{L}\p{N}](?:.*[\p{L}\p{N}])?"
    some = F.filter(found(F.col("text"), IDENTIFIER), lambda x: F.length(F.regexp_extract(x["m"], core, 0)) >= LEAST)

    def token(x: Column) -> Column:
        inner = F.regexp_extract(x["m"], core, 0)
        start = x["start"] + F.instr(x["m"], F.substring(inner, 1, 1000)) - 1
        return F.struct(start.cast("int").alias("start"), (start + F.length(inner)).cast("int").alias("end"), F.xxhash64(F.lower(inner)).alias("instance"), inner.rlike(SECRET).alias("seed"), F.lit(False).alias("base"))

    def seed(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["instance"].alias("instance"), F.lit(True).alias("seed"), F.lit(True).alias("base"))

    def instance(x: Column) -> Column:
        left, right = words(before(F.col("pieces"), x["start"])), words(after(F.col("pieces"), x["end"]))
        two = F.array_join(F.slice(left, -2, 2), " ")
        patterns = F.array(F.concat(F.lit("<"), F.try_element_at(left, F.lit(-1))), F.when(F.size(left) > 1, F.concat(F.lit("<"), two)), F.concat(F.lit(">"), F.try_element_at(right, F.lit(1))))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["instance"].alias("instance"), F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"), x["seed"].alias("seed"), x["base"].alias("known"))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,instance:bigint,seed:boolean,base:boolean>>)")
    tokens = F.when(F.col("text").rlike("[0-9]"), F.transform(some, token)).otherwise(none)
    read = source.select("doc_id", "text", seeds(F.col("text")).alias("seeds"), tokens.alias("tokens"))
    outside = F.filter("tokens", lambda x: ~overlaps(F.col("seeds"), x["start"], x["end"]))
    read = read.select("doc_id", "text", "seeds", F.concat(F.transform("seeds", seed), outside).alias("instances"))
    pieces = F.when(F.size("instances") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    read = read.select("doc_id", F.xxhash64("text").alias("text_hash"), "seeds", "instances", pieces.alias("pieces"))
    base = F.transform("seeds", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return read.select("doc_id", "text_hash", base.alias("base"), F.transform("instances", instance).alias("instances"))


def specific(occurrences: DataFrame, graph: DataFrame, docs: DataFrame, made: list[str]) -> DataFrame:
    """The patterns that may be trusted: with SUPPORT distinct seeds that are SEEDED of its instances or more, and phrases that stand beside an instance in SPECIFIC of their occurrences."""
    support = graph.groupBy("pattern").agg(F.sum("seed").alias("seeds"), F.count("*").alias("n")).filter((F.col("seeds") >= SUPPORT) & (F.col("seeds") >= SEEDED * F.col("n")))
    beside = occurrences.select(F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("beside"))
    asked = cut(support.join(beside, "pattern").select("pattern", "beside", F.substring("pattern", 2, 1000).alias("phrase")), made)
    # each word beside the one before it; the few that end an asked phrase go on
    spoken = docs.select(words(F.col("text").cast("string")).alias("w")).select(F.inline(F.arrays_zip(F.concat(F.array(F.lit("")), "w"), "w")).alias("one", "two"))
    ends = spoken.join(cut(asked.select(F.substring_index("phrase", " ", -1).alias("two")).distinct(), made), "two", "left_semi")
    phrases = ends.select(F.explode(F.array("two", F.concat_ws(" ", "one", "two"))).alias("phrase")).join(asked.select("phrase").distinct(), "phrase", "left_semi")
    counts = phrases.groupBy("phrase").agg(F.count("*").alias("n"))
    return cut(asked.join(counts, "phrase").filter(F.col("beside") >= F.col("n") * SPECIFIC).select("pattern"), made)


def discover(read: DataFrame, docs: DataFrame, made: list[str]) -> DataFrame:
    """doc_id, text_hash, added: the spans that trusted patterns add (only rows that have any)."""
    occurrences = cut(read.select("doc_id", "text_hash", F.inline("instances")), made)
    graph = cut(occurrences.select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("double")).alias("seed")), made)
    graph = cut(graph.join(specific(occurrences, graph, docs, made), "pattern", "left_semi"), made)
    scored = graph.withColumn("score", F.col("seed"))
    for _ in range(ROUNDS):
        # a single word has to earn its confidence from seeds; what discovery found counts for two words alone
        own = F.when(F.col("pattern").contains(" "), F.avg("score")).otherwise(F.avg("seed"))
        trusted = cut(scored.groupBy("pattern").agg(own.alias("confidence")).filter(F.col("confidence") >= CONFIDENCE), made)
        best = graph.join(trusted, "pattern").groupBy("instance").agg(F.max("confidence").alias("best"))
        scored = cut(graph.join(best, "instance", "left").withColumn("score", F.greatest("seed", F.coalesce("best", F.lit(0.0)))).drop("best"), made)
    fresh = occurrences.filter(~F.col("known")).select("doc_id", "text_hash", "start", "end", F.explode("patterns").alias("pattern")).filter(F.col("pattern").startswith("<")).join(trusted, "pattern", "left_semi")
    span = F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")
    return fresh.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(span)).alias("added"))


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base and spans (arrays of start, kind, end; sorted so): a row for each row of ``docs``.

    ``docs`` needs doc_id and text; other columns play no part. A null or empty text has no spans, rows that repeat
    have the same spans each, an empty table gives no rows. Places are code points, ends exclusive.
    """
    made: list[str] = []
    read = cut(read_spans(docs))
    added = cut(discover(read, docs, made))
    discard(docs.sparkSession, made)
    added = added.withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "h")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.expr(f"cast(array() as {SPAN})"))))
    joined = read.join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return joined.select("doc_id", "text_hash", "base", spans.alias("spans"))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the earliest stands for all."""
    names = F.array(*(F.lit(f"[{x.upper()}]") for x in (*KINDS, ADDED)))

    def step(acc: Column, x: Column) -> Column:
        inside = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        kept = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.when(x["start"] < acc["at"], inside).otherwise(F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(kept, names[x["kind"]])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in text (a null text stays null); all columns stay, n_chars follows the text if there is one."""
    spans = extract(docs).filter(F.size("spans") > 0).select("doc_id", "text_hash", "spans").distinct()
    spans = cut(spans.select(F.struct("doc_id", "text_hash", "spans").alias("found")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # apart, whatever its columns are called
    own = F.col("row.text")
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("found.doc_id")) & (F.xxhash64(F.coalesce(own.cast("string"), F.lit(""))) == F.col("found.text_hash"))
    text = F.when(F.col("found").isNull(), own).otherwise(masked(own, F.col("found.spans")))
    out = rows.join(spans, same, "left").withColumn("masked", text)
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
