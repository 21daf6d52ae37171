"""Packing of sources for an answer, and checking of its citations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions import words
from marginalia.functions.columns import let
from marginalia.sources.scratch import kept


def citation(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def packed_sources(ranked: DataFrame, max_chars: int = 35_000, rank: str = "new_rank") -> DataFrame:
    """ranked: query_id, rank, rel_path, start_line, end_line, text. The leading rows whose blocks fit max_chars, with their block."""
    header = F.concat(F.lit("[SOURCE "), F.col(rank).cast("string"), F.lit("] "), citation(F.col("rel_path"), F.col("start_line"), F.col("end_line")), F.lit("\n"))
    x = ranked.withColumn("block", F.concat(header, T.strip(F.col("text")), F.lit("\n")))
    used = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("used", used).where(F.col("used") <= max_chars)


def sources_block(packed: DataFrame, rank: str = "new_rank") -> DataFrame:
    """query_id, sources: one text for each query. packed holds at most a query's budget of characters."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col("block").alias("b")))), lambda s: s["b"])
    return packed.groupBy("query_id").agg(T.strip(F.array_join(parts, "\n")).alias("sources"))


def allowed_citations(packed: DataFrame) -> DataFrame:
    """query_id, allowed: the distinct citations of the packed sources, sorted."""
    return packed.groupBy("query_id").agg(F.sort_array(F.collect_set(citation(F.col("rel_path"), F.col("start_line"), F.col("end_line")))).alias("allowed"))


#: Fixed value: the answer when the sources hold none. The reasons of failure below are fixed texts too.
REFUSAL = "I can't find that in your notes."


def validate_answer(text: Column, allowed: Column, accept_refusal: bool = True) -> Column:
    """OK or the first reason why an answer fails. allowed: an array of citations."""
    evidence = T.strip(F.substring(text, F.locate("Evidence:", text) + len("Evidence:"), F.length(text)))
    bullets = F.filter(F.transform(T.lines(evidence), T.strip), lambda x: x.startswith("-"))

    def verdict(line: Column) -> Column:
        part = lambda g: F.regexp_extract(line, words.CITATION, g)
        key = F.concat(part(1), F.lit(":"), part(2), F.lit("-"), part(3))
        return F.when(~line.contains('"'), "Evidence bullet missing quotes.").when(~line.rlike(words.CITATION), "Evidence bullet missing valid citation format.").when(~F.array_contains(allowed, key), F.concat(F.lit("Citation not in provided sources: "), key))

    checked = let(bullets, lambda b: F.when(F.size(b) == 0, "No evidence bullets.").otherwise(F.coalesce(F.try_element_at(F.filter(F.transform(b, verdict), lambda r: r.isNotNull()), F.lit(1)), F.lit("OK"))))
    out = F.when(~(text.contains("Answer:") & text.contains("Evidence:")), "Missing required sections.").otherwise(checked)
    # The refusal that the instructions ask for is no failure.
    return F.when(T.strip(text) == REFUSAL, "OK").otherwise(out) if accept_refusal else out


INSTRUCTIONS = "Answer only from the sources, in two sections: 'Answer:' and 'Evidence:' with quoted lines that end in (rel_path: start-end)."


def _asked(rows: DataFrame, llm, prompt: Column) -> DataFrame:
    """rows with answer and failure: the model is called once a row, in the tasks; a call that fails is a row with its reason."""
    def run(batches):
        for b in batches:
            answers, failures = [], []
            for p in b.column("_prompt").to_pylist():
                try:
                    answers.append(llm(INSTRUCTIONS, p))
                    failures.append(None)
                except Exception as e:
                    answers.append(None)
                    failures.append(f"{type(e).__name__}: {e}")
            yield b.drop_columns(["_prompt"]).append_column("answer", pa.array(answers, pa.string())).append_column("failure", pa.array(failures, pa.string()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("_prompt", prompt).mapInArrow(run, f"{kinds}, answer string, failure string")


def answers(questions: DataFrame, packed: DataFrame, llm) -> DataFrame:
    """questions: query_id, query. packed: packed_sources(). query_id, query, ok, answer, reason, rounds for every question.

    The model answers each question from its sources; an answer that fails its check is asked for once more, with the reason. A question without
    sources, and one whose second answer fails, gets the refusal; a model that raises an error fails its own question alone. Each round's answers are
    written before they are checked, so no call is made twice.
    """
    x = questions.select("query_id", "query").join(sources_block(packed), "query_id", "left").join(allowed_citations(packed), "query_id", "left")
    x = kept(x, "questions")
    none = x.where("sources is null").select("query_id", "query", F.lit(True).alias("ok"), F.lit(REFUSAL).alias("answer"), F.lit(None).cast("string").alias("reason"), F.lit(0).alias("rounds"))
    prompt = F.concat(F.lit("SOURCES\n"), F.col("sources"), F.lit("\n\nQUESTION\n"), F.col("query"))
    verdict = F.when(F.col("failure").isNotNull(), F.col("failure")).otherwise(validate_answer(F.col("answer"), F.col("allowed")))
    one = kept(_asked(x.where("sources is not null"), llm, prompt), "answers").withColumn("reason", verdict)
    again = one.where("reason <> 'OK'").withColumnRenamed("answer", "last").drop("failure")
    more = F.concat(prompt, F.lit("\n\nYour last answer failed: "), F.col("reason"), F.lit("\n"), F.coalesce("last", F.lit("")))
    two = kept(_asked(again, llm, more).drop("reason", "last"), "answers").withColumn("reason", verdict)

    def told(rows: DataFrame, rounds: int) -> DataFrame:
        good = F.col("reason") == "OK"
        return rows.select("query_id", "query", good.alias("ok"), F.when(good, F.col("answer")).otherwise(REFUSAL).alias("answer"), F.when(~good, F.col("reason")).alias("reason"), F.lit(rounds).alias("rounds"))

    return none.unionByName(told(one.where("reason = 'OK'"), 1)).unionByName(told(two, 2))


def recent_turns(turns: DataFrame, most_turns: int = 12, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last 2 * most_turns rows of each conversation."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return turns.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= 2 * most_turns).drop("_k")
