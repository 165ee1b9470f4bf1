"""Names in texts: a two-level token trie of the dictionary meets the texts' positions by equi-joins, and longer mentions cover shorter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import broadcast_if_small, persist_table

NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case; empty for null."""
    return F.coalesce(F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != ""), F.array().cast("array<string>"))


def mention_spans(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, start, stop, gram, entity, entities): names (entity, name) of any number of words in texts (id, text).

    start and stop are places among the text's tokens; gram is the name as found; entities counts the entities of that name. A
    mention that lies within a longer one is left out; names that only overlap both stay. Neither short nor many names are cut:
    a position is looked up by its first word, which tells how many words names that begin so have, and then by whole names.
    """
    d = persist_table(names.select("entity", tokens(F.col("name")).alias("t")).filter("size(t) > 0").select("entity", F.array_join("t", " ").alias("gram"), F.element_at("t", 1).alias("first"), F.size("t").alias("n")).distinct(), "names")
    longest = d.agg(F.max("n")).first()[0] or 1
    roots = broadcast_if_small(persist_table(d.groupBy("first").agg(F.collect_set("n").alias("sizes")), "roots"))
    w = F.col("w")
    positions = texts.select("id", tokens(F.col("text")).alias("w")).filter("size(w) > 0").select("id", F.posexplode(F.transform(w, lambda t, i: F.slice(w, i + 1, longest))).alias("start", "ahead"))
    begun = positions.withColumn("first", F.col("ahead")[0]).join(roots, "first").select("id", "start", "ahead", F.explode("sizes").alias("n")).filter("n <= size(ahead)")
    grams = begun.select("id", "start", (F.col("start") + F.col("n")).alias("stop"), F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " ").alias("gram"))
    whole = persist_table(d.groupBy("gram").agg(F.count_distinct("entity").alias("entities")), "whole-names")
    spans = grams.join(broadcast_if_small(whole), "gram")
    before = Window.partitionBy("id").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    kept = spans.withColumn("reach", F.max("stop").over(before)).filter("reach is null or reach < stop").drop("reach")
    return kept.join(broadcast_if_small(d.select("gram", "entity")), "gram").select("id", "start", "stop", "gram", "entity", "entities")


def grounded_answers(questions: DataFrame, names: DataFrame, places: DataFrame, observations: DataFrame, chunks: DataFrame, coordinates: str, evidence: str) -> DataFrame:
    """(question, disposition, warning, kind, evidence): each question's disposition, with a row for each piece of evidence.

    questions: id, text. names: entity, name. places: place, name. observations: observation, entity, place, observed_at (text),
    sensitivity. chunks: id, text. coordinates and evidence are patterns of words that ask for exact places and for sources.
    An empty question abstains; a name of several entities asks back; no name, or no observation at the place and in the month
    named, abstains; exact coordinates whose first observation is withheld abstain with that as evidence. Else the
    observations answer, and where sources are asked for one entity its first chunk that mentions it is added.
    """
    q = questions.select(F.col("id").alias("question"), F.coalesce("text", F.lit("")).alias("text"))
    q = q.withColumn("month", F.regexp_replace(F.nullif(F.regexp_extract("text", r"(\d{4}-\d{2})(?!\d)", 1), F.lit("")), "$", "")).withColumn("exact", F.lower("text").rlike(coordinates)).withColumn("sources", F.lower("text").rlike(evidence))
    found = persist_table(mention_spans(questions, names).select(F.col("id").alias("question"), "entity", "entities").distinct(), "linked")
    where = mention_spans(questions, places.select(F.col("place").alias("entity"), "name")).groupBy(F.col("id").alias("question")).agg(F.min_by("entity", F.struct(-F.length("gram"), "entity")).alias("place"))
    of = found.groupBy("question").agg(F.max("entities").alias("most"), F.count_distinct("entity").alias("linked"))
    q = persist_table(q.join(of, "question", "left").join(where, "question", "left"), "questions")
    o = observations.select("observation", "entity", F.col("place").alias("at"), F.substring("observed_at", 1, 7).alias("ym"), "sensitivity")
    hits = found.join(q.filter("most = 1").select("question", "place", "month"), "question").join(o, "entity")
    hits = persist_table(hits.filter("(place is null or place = at) and (month is null or month = ym)").select("question", "entity", "observation", "sensitivity").distinct(), "matching")
    seen = hits.groupBy("question").agg(F.count_distinct("entity").alias("seen"), F.min("entity").alias("entity"), F.min_by(F.struct("observation", "sensitivity"), "observation").alias("one"))
    j = q.join(seen, "question", "left")
    held = F.col("exact") & (F.col("one.sensitivity") == "withheld")
    ladder = (
        F.when(F.trim("text") == "", F.struct(F.lit("abstain"), F.lit("empty_question")))
        .when(F.col("most") > 1, F.struct(F.lit("clarify"), F.lit("ambiguous_name")))
        .when(F.col("linked").isNull(), F.struct(F.lit("abstain"), F.lit("no_entity")))
        .when(F.col("seen").isNull(), F.struct(F.lit("abstain"), F.lit("no_observation")))
        .when(held, F.struct(F.lit("abstain"), F.lit("sensitive_coordinates_withheld")))
        .otherwise(F.struct(F.lit("answer"), F.lit(None).cast("string")))
    )
    told = persist_table(j.select("question", ladder.alias("l"), "sources", "seen", "entity", F.col("one.observation").alias("first")).select("question", F.col("l.col1").alias("disposition"), F.col("l.col2").alias("warning"), "sources", "seen", "entity", "first"), "told")
    cited = told.filter("disposition = 'answer'").join(hits.select("question", F.col("observation").alias("evidence")), "question").select("question", F.lit("observation").alias("kind"), "evidence")
    withheld = told.filter("warning = 'sensitive_coordinates_withheld'").select("question", F.lit("observation").alias("kind"), F.col("first").alias("evidence"))
    asked = told.filter("disposition = 'answer' and sources and seen = 1")
    wanted = names.join(asked.select("entity").distinct(), "entity", "left_semi")
    about = mention_spans(chunks, wanted).groupBy("entity").agg(F.min("id").alias("evidence"))
    related = asked.join(about, "entity").select("question", F.lit("chunk").alias("kind"), "evidence")
    return told.select("question", "disposition", "warning").join(cited.unionByName(withheld).unionByName(related), "question", "left")
