"""Token accounting of answers and the report over stored invocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes a token, and the least that an answer's files are taken to cost: fixed values.
BYTES_PER_TOKEN, FACTOR, FLOOR = 4, 8, 1200
#: Dollars a million tokens by model.
RATES = {"default": 2.5}
#: Days of a period before the time of asking; None takes all.
PERIODS = {"all": None, "today": 1, "7d": 7, "30d": 30}


def impact(answers: DataFrame, touched: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``(answer, optimized_tokens, raw_tokens, tokens_saved)``: what an answer costs against its files read whole.

    ``answers`` is ``(answer, body)``, ``touched`` ``(answer, id, path)`` with either of both; each file counts once an answer.
    An answer that touches no known file is held against the floor alone.
    """
    own = touched.where("id is not null").join(nodes.select("id", F.col("file_path").alias("at")), "id").select("answer", F.col("at").alias("path"))
    seen = own.union(touched.where("path is not null").select("answer", "path")).distinct()
    raw = seen.join(files.select("path", "size_bytes"), "path").groupBy("answer").agg(F.sum(F.floor(F.col("size_bytes") / BYTES_PER_TOKEN)).alias("whole"))
    cost = F.ceil(F.octet_length("body") / BYTES_PER_TOKEN)
    out = answers.select("answer", cost.alias("optimized_tokens")).join(raw, "answer", "left")
    out = out.withColumn("raw_tokens", F.greatest(F.coalesce("whole", F.lit(0)), FACTOR * F.col("optimized_tokens"), F.lit(FLOOR)))
    return out.select("answer", "optimized_tokens", "raw_tokens", (F.col("raw_tokens") - F.col("optimized_tokens")).alias("tokens_saved"))


def _sums(rate: float) -> list[Column]:
    raw, saved = F.coalesce(F.sum("raw_tokens"), F.lit(0)), F.coalesce(F.sum("tokens_saved"), F.lit(0))
    share = F.when(raw > 0, F.round(saved * 100 / raw, 1)).otherwise(F.lit(0.0))
    return [F.count("*").alias("calls"), raw.alias("raw_tokens"), F.coalesce(F.sum("optimized_tokens"), F.lit(0)).alias("optimized_tokens"), saved.alias("tokens_saved"), share.alias("reduction"), F.round(saved * rate / 1e6, 4).alias("usd"), F.round(F.coalesce(F.avg("duration_ms"), F.lit(0)), 1).alias("mean_ms")]


def report(invocations: DataFrame, period: str = "all", model: str = "default", now: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary, rows by tool, and sync counts of a period that ends at ``now``; sync counts are over all."""
    days = PERIODS[period]
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    since = F.date_trunc("day", at) if period == "today" else at - F.make_dt_interval(F.lit(days or 0))
    own = invocations if days is None else invocations.where((F.col("ts") >= since) & (F.col("ts") <= at))
    sums = _sums(RATES.get(model, RATES["default"]))
    sync = invocations.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("synced").cast("int")), F.lit(0)).alias("synced"))
    return own.agg(*sums), own.groupBy("tool_name").agg(*sums).orderBy(F.desc("tokens_saved"), "tool_name"), sync.withColumn("pending", F.expr("total - synced"))


def report_text(invocations: DataFrame, repo: str, period: str = "all", model: str = "default", now: str | None = None) -> str:
    """The report as lines; one per tool, of which there are few."""
    total, tools, sync = report(invocations, period, model, now)
    t, s = total.first(), sync.first()
    line = lambda r, name: f"{name:<20}{r.calls:>10}{r.raw_tokens:>14,}{r.optimized_tokens:>14,}{r.tokens_saved:>14,}{r.reduction:>8.1f}%{r.mean_ms:>10.0f} ms"
    head = [f"Repository: {repo}", f"Period: {period}", f"Synced: {s.synced} of {s.total} ({s.pending} pending)", f"Saved: {t.tokens_saved:,} tokens, ${t.usd:.2f}"]
    return "\n".join([*head, *[line(r, r.tool_name) for r in tools.collect()], line(t, "total")])
