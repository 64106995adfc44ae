"""Personal data by information-theoretic sanitisation, in DataFrame functions only.

1. Protected entities: e-mail and IP addresses, card and phone numbers, found by pattern and
   checked (parts of an address, digits, Luhn sum).
2. Co-occurrence: the terms (words of three letters or more) within ``CONTEXT`` code points
   of an entity, and the number of different texts in which a term stands there. Of all texts
   that have the term, the part that has it beside the entity tells how far the term gives
   the entity away. With N texts, a term t discloses an entity e if

       PMI(e; t) = log(N n(e, t) / (n(e) n(t)))  >=  DISCLOSED * log(N / n(e)) = DISCLOSED * IC(e)

   and n(e, t) is at least ``SUPPORT``. Equal texts count once: a copy is no new evidence.
3. A document that holds an entity loses the terms that disclose it, wherever in the document
   they stand. A term is generalised to its first three letters if all words that start so
   stay below the threshold together, and removed if not. Entities give way to their kind.

Documents without an entity have nothing to protect and stay as they are.

Scale: texts are written once to the shared folder, in blocks of rows, then read where they
lie; only entities, their terms, row numbers and counts are shuffled, counts after partial sums, and of the texts those that
hold an entity and meet its terms. A passage in a third of all documents is one entity with
partial sums; a run of characters of any length is looked at once per pattern (possessive
quantifiers, and no match starts inside a run that has failed).

Defined results: null and empty texts have no spans; repeated rows are rows of their own with
equal spans; ids are not looked at; positions are code points, end exclusive; spans do not
overlap, save those of different kinds of entities; columns named like the new ones are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.llm.blocks import remove_folder, saved, shuffle_partitions
from pagefold.session import checkpoint_dir

#: Kinds in the order in which spans are listed; terms come last.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
CONTEXT = 100
SUPPORT = 3
DISCLOSED = 0.9
#: Letters that a generalised term keeps.
STEM = 3
_TEXT = "_text"
#: The same matches as the plain patterns, without starts inside a run that cannot match.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
_WORD = r"\p{L}{3,}+"
CHUNK = 128
#: Rows of a block, as a power of two: neighbours in one file.
BLOCK_BITS = 10


def _with_sums(df: DataFrame, lengths: str, out: str) -> DataFrame:
    """``df`` with the running sums of an array column of numbers, chunk by chunk, so that a long array costs no
    square. Each step is a column of its own: an expression inside a lambda function is worked out per element."""
    zero = F.lit(0).cast("long")
    add = lambda part: F.aggregate(part, zero, lambda a, x: a + x)
    part = lambda c: F.slice(lengths, c * CHUNK + 1, CHUNK)
    chunks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / CHUNK).cast("int"))
    df = df.withColumn("_wholes", F.transform(chunks, lambda c: add(part(c))))
    df = df.withColumn("_before", F.transform("_wholes", lambda _, c: add(F.slice("_wholes", 1, c))))
    running = F.flatten(F.transform("_before", lambda b, c: F.transform(part(c), lambda _, i: b + add(F.slice(part(c), 1, i + 1)))))
    return df.withColumn(out, running).drop("_wholes", "_before")


def _found(df: DataFrame, pattern: str, could: Column, out: str) -> DataFrame:
    """``df`` with the matches of a pattern as an array of spans with their contexts: what is between two matches, and
    the matches, have the text's length together."""
    gaps, values, lengths, stops = (f"{out}_{x}" for x in ("gaps", "values", "lengths", "stops"))
    none = F.array().cast("array<string>")
    df = df.withColumns({gaps: F.when(could, F.split(_TEXT, pattern, -1)).otherwise(none),
                         values: F.when(could, F.regexp_extract_all(_TEXT, F.lit(pattern), F.lit(0))).otherwise(none)})
    df = df.withColumn(lengths, F.transform(values, lambda v, i: (F.length(v) + F.length(F.col(gaps)[i])).cast("long")))
    df = _with_sums(df, lengths, stops)
    spans = F.transform(values, lambda v, i: F.struct(
        (F.col(stops)[i] - F.length(v)).alias("start"), F.col(stops)[i].alias("stop"), v.alias("value"),
        F.right(F.col(gaps)[i], F.lit(CONTEXT)).alias("before"), (F.length(F.col(gaps)[i]) > CONTEXT).alias("cut_before"),
        F.left(F.col(gaps)[i + 1], F.lit(CONTEXT)).alias("behind"), (F.length(F.col(gaps)[i + 1]) > CONTEXT).alias("cut_behind")))
    return df.withColumn(out, spans).drop(gaps, values, lengths, stops)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    doubled = lambda d, i: F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: doubled(F.substring(digits, -i, F.lit(1)).cast("int"), i)),
                        F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def _part_ok(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(plain) <= 3, F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255).otherwise(False)


def entities(df: DataFrame) -> DataFrame:
    """``df`` (with ``_text``) with an array of checked spans per kind."""
    text = F.col(_TEXT)
    could = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
             "card": text.rlike(r"[0-9](?:[ -]?[0-9]){12}"), "phone": text.contains("+")}
    checks = {"email": lambda s: F.lit(True), "ip": lambda s: F.forall(F.split(s["value"], r"\."), _part_ok),
              "card": lambda s: _luhn(s["value"]), "phone": lambda s: F.length(_digits(s["value"])).between(9, 15)}
    for kind in KINDS:
        df = _found(df, _PATTERNS[kind], could[kind], f"_{kind}")
        df = df.withColumn(f"_{kind}", F.filter(f"_{kind}", checks[kind]))
    return df


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))


def _terms_near(span: Column) -> Column:
    """The words beside an entity, lower case; a word that the context's edge cuts is none."""
    before = F.concat(F.when(span["cut_before"], "").otherwise(" "), span["before"], F.lit(" "))
    behind = F.concat(F.lit(" "), span["behind"], F.when(span["cut_behind"], "").otherwise(" "))
    whole = F.lit(r"(?<=\P{L})\p{L}{3,}+(?=\P{L})")
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(before), whole, F.lit(0)), F.regexp_extract_all(F.lower(behind), whole, F.lit(0))))


def _classes(words: Column) -> Column:
    """Terms and the classes of words with one beginning that they belong to."""
    return F.array_union(words, F.transform(words, lambda w: F.concat(F.left(w, F.lit(STEM)), F.lit("*"))))


def _each_text_once(parsed: DataFrame) -> DataFrame:
    """The different texts. Only the numbers of the rows that hold one first are sent, a list per block; the texts are
    read where they lie."""
    first = parsed.groupBy("text_id").agg(F.min("_row").alias("_row")).select(_block("_row"), "_row")
    first = first.groupBy("_block").agg(F.collect_list("_row").alias("_first"))
    met = parsed.select("_block", "_row", _TEXT).join(first.hint("shuffle_hash"), "_block")
    return met.where(F.array_contains("_first", F.col("_row"))).select(_TEXT)


def disclosing_terms(parsed: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """(entity, term, kept): the terms that disclose an entity; ``kept`` is the beginning left of a generalised one."""
    # hashed before anything is exploded, or every exploded row would carry its text along
    parsed = parsed.where(F.col(_TEXT).isNotNull()).withColumn("text_id", F.xxhash64(_TEXT, F.length(_TEXT)))
    found = F.concat(*(F.transform(f"_{k}", lambda s: F.struct(F.lower(s["value"]).alias("entity"), _terms_near(s).alias("near"))) for k in KINDS))
    held = parsed.where(F.col("_held") > 0).select("text_id", found.alias("found")).select("text_id", F.explode("found").alias("e"))
    held = saved(held.select("text_id", "e.entity", "e.near"))
    beside = held.select("text_id", "entity", F.explode(_classes(F.col("near"))).alias("term")).distinct()
    together = saved(beside.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support))
    n_entity = held.select("text_id", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    # the terms of every different text, once, counted in the tasks before anything is sent
    words = F.array_distinct(F.regexp_extract_all(F.lower(_TEXT), F.lit(_WORD), F.lit(0)))
    all_terms = _each_text_once(parsed).select(words.alias("words")).select(_classes(F.col("words")).alias("words"))
    all_terms = all_terms.select(F.explode_outer("words").alias("term")).where("term IS NOT NULL")
    n_term = all_terms.groupBy("term").agg(F.count("*").alias("n_term"))
    n = parsed.select("text_id").distinct().count()
    pmi = F.log(F.lit(float(n)) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    discloses = pmi >= disclosed * F.log(F.lit(float(n)) / F.col("n_entity"))
    judged = together.join(n_entity, "entity").join(n_term, "term").select("entity", "term", discloses.alias("discloses"))
    judged = saved(judged)
    telling = judged.where(F.col("discloses") & ~F.endswith("term", F.lit("*")))
    stems = judged.where(~F.col("discloses") & F.endswith("term", F.lit("*"))).select("entity", F.col("term").alias("kept"))
    return (telling.withColumn("kept", F.concat(F.left("term", F.lit(STEM)), F.lit("*"))).join(stems.withColumn("below", F.lit(True)), ["entity", "kept"], "left")
            .select("entity", "term", F.when(F.col("below"), F.col("kept")).otherwise("").alias("kept")))


def _apart(span: Column) -> Column:
    """The span touches no entity."""
    clear = F.lit(True)
    for k in KINDS:
        clear = clear & ~F.exists(f"_{k}", lambda b: (span["start"] < b["stop"]) & (b["start"] < span["stop"]))
    return clear


def _rewritten() -> Column:
    """The text with what stands for each span. Overlapping entities give way to the first of them."""
    def mark(column: str, shown):
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), shown(s).alias("shown")))
    marks = F.concat(*(mark(f"_{k}", lambda _, k=k: F.lit(f"[{k.upper()}]")) for k in KINDS), mark("_term", lambda s: s["shown"]))
    start = F.struct(F.lit(0).cast("long").alias("done"), F.array().cast("array<string>").alias("parts"))
    step = lambda a, s: F.when(s["start"] < a["done"], a).otherwise(F.struct(
        s["stop"].alias("done"), F.concat(a["parts"], F.array(F.substring(F.col(_TEXT), (a["done"] + 1).cast("int"), (s["start"] - a["done"]).cast("int")), s["shown"])).alias("parts")))
    return F.aggregate(F.array_sort(marks), start, step, lambda a: F.concat(
        F.array_join(a["parts"], ""), F.substring(F.col(_TEXT), (a["done"] + 1).cast("int"), F.length(_TEXT))))


def _block(row: str) -> Column:
    return F.shiftright(row, BLOCK_BITS).alias("_block")


def _written(df: DataFrame) -> DataFrame:
    """The same rows, numbered by ``_row``, as Parquet in the shared folder, bucketed by ``_block``; the files go at exit."""
    spark = df.sparkSession
    name = f"llm_sanitise_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    df = df.withColumn("_row", F.monotonically_increasing_id())
    (df.select("*", _block("_row")).write.format("parquet").option("path", path)
       .bucketBy(min(shuffle_partitions(spark), 100_000), "_block").saveAsTable(name))
    table = spark.table(name)
    table.schema  # resolve before the catalog entry goes; the files stay
    spark.sql(f"DROP TABLE {name}")

    def clear():
        if getattr(spark.sparkContext, "_jsc", None) is not None and not spark.sparkContext._jsc.sc().isStopped():
            remove_folder(spark, path)
    atexit.register(clear)
    return table


def sanitise(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """``docs`` with ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` and ``n_term`` (long), ``base_spans`` and ``spans``
    (kind:start:end, in order of kind and start) and ``sanitised``, the text without what it should not tell."""
    new = [*(f"n_{k}" for k in (*KINDS, TERM)), "base_spans", "spans", "sanitised"]
    kept = [c for c in docs.columns if c not in new]
    others = [c for c in kept if c != text_col]  # the text is written once
    rows = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("_kept"), F.col(text_col).alias(_TEXT))
    parsed = entities(rows).withColumn("_held", sum((F.size(f"_{k}") for k in KINDS), F.lit(0)))
    parsed = _written(parsed)
    telling = disclosing_terms(parsed, support, disclosed)
    held = parsed.where(F.col("_held") > 0)
    entity = F.explode(F.array_distinct(F.concat(*(F.transform(f"_{k}", lambda s: F.lower(s["value"])) for k in KINDS))))
    hits = (held.select("_row", entity.alias("entity")).join(telling, "entity")
            .groupBy("_row", "term").agg(F.min("kept").alias("kept"))  # removed for one entity, removed
            .groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "kept"))).alias("_telling")))
    met = _found(held.join(hits, "_row", "left"), _WORD, F.col("_telling").isNotNull(), "_term")
    shown = lambda s: F.col("_telling")[F.lower(s["value"])]
    none = F.array().cast("array<struct<start:bigint,stop:bigint,shown:string>>")
    met = met.withColumn("_term", F.coalesce(F.transform(F.filter("_term", lambda s: shown(s).isNotNull() & _apart(s)), lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), shown(s).alias("shown"))), none)).drop("_telling")
    clean = parsed.where(F.col("_held") == 0).withColumn("_term", none)
    base = F.concat(*(_listed(k, F.col(f"_{k}")) for k in KINDS))
    return met.unionByName(clean).select(
        *((F.col(_TEXT) if c == text_col else F.col("_kept")[c]).alias(c) for c in kept), *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in (*KINDS, TERM)),
        F.array_join(base, ",").alias("base_spans"), F.array_join(F.concat(base, _listed(TERM, F.col("_term"))), ",").alias("spans"),
        _rewritten().alias("sanitised"))
