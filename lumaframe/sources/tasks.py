"""Task documents as a host sends them, and the answers it expects, as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions.media import clamp

TASK = "server_connection map<string,string>, args struct<mode:string,hookContext:struct<type:string,id:bigint>,scene_id:string,image_id:string>"
NO_JSON = "input is no JSON document"


def parsed_tasks(documents: DataFrame) -> DataFrame:
    """name, mode, hook_type, image_id, error of documents (name, text). What is no JSON has an error and nothing else."""
    task = F.from_json("text", TASK + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    bad = F.col("text").isNull() | F.col("t._broken").isNotNull()
    return documents.withColumn("t", task).select(
        "name",
        F.when(~bad, F.col("t.args.mode")).alias("mode"),
        F.when(~bad, F.col("t.args.hookContext.type")).alias("hook_type"),
        F.when(~bad, F.col("t.args.hookContext.id")).alias("image_id"),
        F.when(bad, NO_JSON).alias("error"),
    )


def results(tasks: DataFrame) -> DataFrame:
    """name, result: {"output": ...} or {"error": ...}."""
    good, bad = F.to_json(F.struct(F.col("output"))), F.to_json(F.struct(F.col("error")))
    return tasks.select("name", F.when(F.col("error").isNull(), good).otherwise(bad).alias("result"))


def log_line(level: Column, message: Column) -> Column:
    """A line of the log as a host reads it: the letter of the level (t, d, i, w, e, p) between control characters, then the message."""
    return F.concat(F.lit("\x01"), level, F.lit("\x02"), message)


def progress_line(done: Column) -> Column:
    """The line that reports progress, between 0 and 1 whatever `done` is."""
    return log_line(F.lit("p"), clamp(done).cast("string"))
