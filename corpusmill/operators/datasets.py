"""Training sets from exported records, and answers of several models made into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse

RESPONSE = "Response:\n"


def instruction_text(record: DataFrame) -> Column:
    """The text of a record with columns among instruction, input, output, context, answer, text; else its JSON."""
    have = set(record.columns)
    clean = lambda c: collapse(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in have else F.lit("")
    given = lambda *cs: F.lit(True) if set(cs) <= have else F.lit(False)
    present = lambda *cs: given(*cs) if not set(cs) <= have else F.greatest(*(F.col(c).isNotNull() for c in cs)) if len(cs) > 1 else F.col(cs[0]).isNotNull()
    head = F.concat(F.lit("Instruction:\n"), clean("instruction"))
    asked = F.when(clean("input") != "", F.concat(head, F.lit("\n\nInput:\n"), clean("input"))).otherwise(head)
    plain = collapse(F.to_json(F.struct(*(F.col(c) for c in record.columns if c != "line_no"))))
    return (
        F.when(present("instruction", "output"), F.concat(asked, F.lit("\n\n" + RESPONSE), clean("output")))
        .when(present("context", "answer"), F.concat(F.lit("Context:\n"), clean("context"), F.lit("\n\n" + RESPONSE), clean("answer")))
        .when(present("text"), clean("text"))
        .otherwise(plain)
    )


def holdout(records: DataFrame, ratio: float = 0.1) -> DataFrame:
    """Adds split by line_no (from 0): the first max(1, int(n ratio)) lines are validation, the rest train. A set of one line
    is both: its line comes twice."""
    counted = records.crossJoin(F.broadcast(records.agg(F.count("*").alias("_n"))))
    cut = F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))
    sides = F.when(F.col("line_no") >= cut, F.array(F.lit("train"))).when((F.col("_n") <= cut) & (F.col("line_no") == 0), F.array(F.lit("validation"), F.lit("train"))).otherwise(F.array(F.lit("validation")))
    return counted.withColumn("split", F.explode(sides)).drop("_n")


def sft(records: DataFrame, ratio: float = 0.1, max_seq_len: int = 2048) -> DataFrame:
    """line_no, text (at most 2 x max_seq_len characters), split."""
    return holdout(records.select("line_no", F.left(instruction_text(records), F.lit(2 * max_seq_len)).alias("text")), ratio)


def mft(records: DataFrame, teacher: DataFrame | None = None, ratio: float = 0.1) -> DataFrame:
    """line_no, text, corrective, split. The corrective is the teacher's at the same line, else what follows "Response:"."""
    base = records.select("line_no", instruction_text(records).alias("text"))
    at = F.instr("text", RESPONSE)
    own = F.when(at > 0, F.substr("text", at + len(RESPONSE), F.length("text"))).otherwise(F.lit(""))
    if teacher is None:
        return holdout(base.withColumn("corrective", own), ratio)
    names = [c for c in ("corrective", "output", "answer") if c in teacher.columns]
    given = teacher.select("line_no", F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in names)).alias("_given"))
    return holdout(base.join(given, "line_no", "left").withColumn("corrective", F.coalesce("_given", own)).drop("_given"), ratio)


def preferences(records: DataFrame) -> DataFrame:
    """prompt, chosen, rejected of records of either shape; incomplete ones are left out."""
    col = lambda c: F.col(c).cast("string") if c in records.columns else F.lit(None).cast("string")
    filled = lambda c: F.nullif(F.trim(col(c)), F.lit(""))
    joined = F.nullif(F.trim(F.concat_ws("\n", filled("instruction"), filled("input"))), F.lit(""))
    rows = records.select(F.coalesce(filled("prompt"), joined).alias("prompt"), F.coalesce(filled("chosen"), filled("accepted")).alias("chosen"), F.coalesce(filled("rejected"), filled("alternative")).alias("rejected"))
    return rows.where("prompt is not null and chosen is not null and rejected is not null")


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """Assistant turns with the user turn right before: conv_id, turn, prompt, completion."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.withColumn("_role", F.lag("role").over(w)).withColumn("_text", F.lag("text").over(w))
    return paired.where("role = 'assistant' and _role = 'user'").select("conv_id", "turn", F.col("_text").alias("prompt"), F.col("text").alias("completion"))


def vote_exact(answers: DataFrame) -> DataFrame:
    """The most frequent text of each question, the first seen of equals. answers: question_id, pos, text."""
    counted = answers.groupBy("question_id", "text").agg(F.count("*").alias("votes"), F.min("pos").alias("first"))
    best = Window.partitionBy("question_id").orderBy(F.desc("votes"), "first")
    return counted.withColumn("n", F.row_number().over(best)).where("n = 1").select("question_id", F.col("text").alias("answer"), "votes")


def vote_normalized(answers: DataFrame) -> DataFrame:
    """The longest original of the most frequent text, case and ends aside."""
    plain = F.lower(F.trim("text"))
    counted = answers.groupBy("question_id", plain.alias("plain")).agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max_by("text", F.struct(F.length("text"), -F.col("pos"))).alias("answer"))
    best = Window.partitionBy("question_id").orderBy(F.desc("votes"), "first")
    return counted.withColumn("n", F.row_number().over(best)).where("n = 1").select("question_id", "answer", "votes")


def combine(answers: DataFrame) -> DataFrame:
    """question_id and the answers by the strategies first, concat and rerank (longest)."""
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t")))), lambda x: F.trim(x["t"])), lambda t: t != "")
    return answers.groupBy("question_id").agg(F.min_by("text", "pos").alias("first"), F.array_join(parts, " ").alias("concat"), F.max_by("text", F.struct(F.length("text"), -F.col("pos"))).alias("rerank"))
