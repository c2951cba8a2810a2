"""Features and detectors on ordered calls of sessions, by window functions.

Every window is partitioned by session and ordered by time and call id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACTIONS = ("explore", "execute", "edit", "orchestrate", "reason")

# fixed values: tools by the kind of action they are; any other named tool integrates
TOOL_ACTIONS = {
    "explore": ("Read", "Grep", "Glob", "LS", "ToolSearch", "NotebookRead", "WebFetch", "WebSearch"),
    "edit": ("Edit", "Write", "MultiEdit", "NotebookEdit", "ApplyPatch"),
    "execute": ("Bash", "PowerShell"),
    "orchestrate": ("Task", "Agent", "Skill", "TaskCreate", "TaskUpdate", "TaskList"),
}
# fixed values: endings of files by class
EXTENSIONS = {
    "code": ("go", "ts", "tsx", "js", "jsx", "py", "rs", "java", "kt", "c", "cc", "cpp", "h", "hpp", "rb", "php", "cs", "swift", "scala", "sql", "vue", "svelte"),
    "config": ("json", "yaml", "yml", "toml", "ini", "env", "cfg", "conf", "lock", "xml"),
    "docs": ("md", "mdx", "txt", "rst", "adoc"),
    "data": ("csv", "tsv", "parquet", "db", "sqlite"),
}
# fixed values: signs of an error at the beginning of a tool's result
ERROR_MARKERS = ("Traceback (most recent call last)", "FAILED", "Error:", "error:")


def ordered(by: str = "session_key", ts: str = "ts", tie: str = "call_id"):
    return W.partitionBy(by).orderBy(ts, tie)


def positions(calls: DataFrame) -> DataFrame:
    return calls.withColumn("pos", F.row_number().over(ordered()).cast("long"))


def lag_actions(calls: DataFrame, depth: int = 5) -> DataFrame:
    """The previous ``depth`` actions, 'none' where there are fewer."""
    w = ordered()
    return calls.select("call_id", *[F.coalesce(F.lag("action", k).over(w), F.lit("none")).alias(f"prev_{k}") for k in range(1, depth + 1)])


def last_k_counts(calls: DataFrame, k: int) -> DataFrame:
    """How often each action occurs in the k calls before."""
    w = ordered().rowsBetween(-k, -1)
    return calls.select("call_id", *[F.count_if(F.col("action") == a).over(w).alias(f"n_{a}") for a in ACTIONS])


def cumulative_share(calls: DataFrame) -> DataFrame:
    """Share of each action among all calls before; 0 for the first call."""
    w = ordered().rowsBetween(W.unboundedPreceding, -1)
    n = F.count("*").over(w)
    return calls.select("call_id", *[F.coalesce(F.try_divide(F.count_if(F.col("action") == a).over(w).cast("double"), F.nullif(n, F.lit(0))), F.lit(0.0)).alias(f"share_{a}") for a in ACTIONS])


def since_last(calls: DataFrame, cap: int = 50) -> DataFrame:
    """log1p of the calls since each action, at most ``cap``; the cap where it never was."""
    p = positions(calls)
    w = ordered().rowsBetween(W.unboundedPreceding, -1)
    return p.select("call_id", *[F.log1p(F.least(F.coalesce(F.col("pos") - F.max(F.when(F.col("action") == a, F.col("pos"))).over(w), F.lit(cap)), F.lit(cap)).cast("double")).alias(f"since_{a}") for a in ACTIONS])


def runs(df: DataFrame, value: Column, by: str = "session_key") -> DataFrame:
    """streak: how many rows in a row, up to each, have the same value."""
    w = ordered(by)
    change = F.coalesce((F.lag(value).over(w).eqNullSafe(value)).cast("int"), F.lit(0)) == 0
    marked = df.withColumn("__new", F.when(F.row_number().over(w) == 1, 1).when(change, 1).otherwise(0))
    grouped = marked.withColumn("__run", F.sum("__new").over(w))
    inner = W.partitionBy(by, "__run").orderBy("ts", "call_id")
    return grouped.withColumn("streak", F.row_number().over(inner).cast("long")).drop("__new", "__run")


def action_entropy(calls: DataFrame) -> DataFrame:
    """Natural entropy of the counts of the actions up to and with each call."""
    w = ordered().rowsBetween(W.unboundedPreceding, 0)
    n = F.count("*").over(w).cast("double")
    terms = [F.count_if(F.col("action") == a).over(w).cast("double") / n for a in ACTIONS]
    total = -sum((F.when(t > 0, t * F.ln(t)).otherwise(0.0) for t in terms[1:]), F.when(terms[0] > 0, terms[0] * F.ln(terms[0])).otherwise(0.0))
    return calls.select("call_id", total.alias("entropy"))


def time_gaps(calls: DataFrame, long_gap: float = 300.0) -> DataFrame:
    """log1p of the seconds since the call before (-1 for the first), whether it was long, and log1p since the start."""
    w = ordered()
    sec = lambda a, b: F.expr(f"timestampdiff(MICROSECOND, {a}, {b})") / 1e6
    g = calls.withColumn("before", F.lag("ts").over(w)).withColumn("start", F.min("ts").over(W.partitionBy("session_key")))
    gap = sec("before", "ts")
    return g.select("call_id", F.when(F.col("before").isNull(), -1.0).otherwise(F.log1p(gap)).alias("gap"), F.coalesce(gap > long_gap, F.lit(False)).alias("long_gap"), F.log1p(sec("start", "ts")).alias("since_start"))


def token_lags(calls: DataFrame) -> DataFrame:
    """log1p of the tokens of the two calls before and of the mean before; 0 where there is none."""
    w = ordered()
    before = w.rowsBetween(W.unboundedPreceding, -1)
    z = lambda c: F.log1p(F.coalesce(c, F.lit(0)).cast("double"))
    return calls.select("call_id", z(F.lag("output_tokens").over(w)).alias("prev"), z(F.lag("output_tokens", 2).over(w)).alias("prev2"), z(F.avg("output_tokens").over(before)).alias("mean"))


def segments(calls: DataFrame, reset: str | None) -> tuple[DataFrame, list[str]]:
    """calls and the columns that part them: the session, and its stretch since the last row with ``reset``."""
    if reset is None:
        return calls, ["session_key"]
    return calls.withColumn("__part", F.sum(F.col(reset).cast("int")).over(ordered())), ["session_key", "__part"]


def repeated_calls(calls: DataFrame, window: int = 10, times: int = 5, reset: str | None = None) -> DataFrame:
    """Calls at which some signature occurs ``times`` times among the last ``window`` ones; a row with ``reset`` begins anew."""
    c, by = segments(calls, reset)
    w = W.partitionBy(*by).orderBy("ts", "call_id").rowsBetween(-(window - 1), 0)
    sigs = c.withColumn("sigs", F.collect_list("sig").over(w))
    most = F.array_max(F.transform(F.array_distinct("sigs"), lambda s: F.size(F.filter("sigs", lambda x: x == s))))
    return sigs.withColumn("most", most.cast("long")).where(F.col("most") >= times).select("session_key", "call_id", "most")


def cyclic_calls(calls: DataFrame, window: int = 30, least: int = 24, ratio: float = 0.4, without: str = "edit", reset: str | None = None) -> DataFrame:
    """Calls with few different signatures among the last ``window`` and no ``without`` action there."""
    c, by = segments(calls, reset)
    w = W.partitionBy(*by).orderBy("ts", "call_id").rowsBetween(-(window - 1), 0)
    c = c.withColumn("n", F.count("*").over(w)).withColumn("kinds", F.size(F.array_distinct(F.collect_list("sig").over(w)))).withColumn("edits", F.count_if(F.col("action") == without).over(w))
    return c.where((F.col("n") >= least) & (F.col("kinds") / F.col("n") < ratio) & (F.col("edits") == 0)).select("session_key", "call_id", "n", F.col("kinds").cast("long").alias("kinds"))


def no_progress(calls: DataFrame, ring: int = 8, times: int = 5, seconds: int = 90) -> DataFrame:
    """Calls whose signature occurs ``times`` times among the last ``ring`` within ``seconds``."""
    w = ordered().rowsBetween(-(ring - 1), 0)
    c = calls.withColumn("last", F.collect_list(F.struct("sig", "ts")).over(w))
    same = F.size(F.filter("last", lambda x: (x["sig"] == F.col("sig")) & (x["ts"] >= F.col("ts") - F.expr(f"interval {seconds} seconds"))))
    return c.withColumn("same", same.cast("long")).where(F.col("same") >= times).select("session_key", "call_id", "same")


def monologue(calls: DataFrame, tool: str = "has_tool", user: str = "user_turn") -> DataFrame:
    """calls with ``monologue``: turns without a tool up to and with each, since the last tool or the user's last text."""
    p = positions(calls)
    last = F.max(F.when(F.col(tool), F.col("pos")).when(F.col(user), F.col("pos") - 1)).over(ordered().rowsBetween(W.unboundedPreceding, 0))
    return p.withColumn("monologue", F.col("pos") - F.coalesce(last, F.lit(0)))


def errored(flag: Column, text: Column, scan: int = 2048) -> Column:
    """Whether a tool's result is an error: by its flag, or by a marker in the first ``scan`` characters."""
    head = F.left(F.coalesce(text, F.lit("")), F.lit(scan))
    marked = F.lit(False)
    for m in ERROR_MARKERS:
        marked = marked | F.contains(head, F.lit(m))
    return F.coalesce(flag, F.lit(False)) | marked


def tool_errors(results: DataFrame, flag: str, text: str) -> DataFrame:
    """Per session: results, errors among them, and how many of the last ones in a row are errors."""
    r = results.withColumn("__bad", errored(F.col(flag), F.col(text)))
    sound = F.max(F.when(~F.col("__bad"), F.struct("ts", "call_id")))
    at = r.groupBy("session_key").agg(F.count("*").alias("total"), F.count_if("__bad").alias("errored"), sound.alias("__sound"))
    behind = r.where("__bad").join(at.select("session_key", "__sound"), "session_key").where(F.col("__sound").isNull() | (F.struct("ts", "call_id") > F.col("__sound"))).groupBy("session_key").agg(F.count("*").alias("streak"))
    return at.drop("__sound").join(behind, "session_key", "left").select("session_key", "total", "errored", F.coalesce("streak", F.lit(0)).alias("trailing_streak"))


def spiral_signals(calls: DataFrame, least: int = 12) -> DataFrame:
    """First call of each session and reason, from the ``least``-th call on.

    error_streak: three errors in a row; same_file: five edits of one file;
    repeats: a third of the last twelve calls are repeats, after twenty calls;
    monologue: four turns without a tool.
    """
    p = runs(monologue(calls), F.col("is_error"))
    last = ordered().rowsBetween(-11, 0)
    same_file = W.partitionBy("session_key", "path").orderBy("ts", "call_id").rowsBetween(W.unboundedPreceding, 0)
    p = p.withColumn("share", 1 - F.size(F.array_distinct(F.collect_list("sig").over(last))) / F.count("*").over(last)).withColumn("edits", F.count_if(F.col("action") == "edit").over(same_file))
    reasons = F.array_compact(F.array(
        F.when(F.col("is_error") & (F.col("streak") >= 3), F.lit("error_streak")), F.when((F.col("action") == "edit") & (F.col("edits") >= 5), F.lit("same_file")),
        F.when((F.col("share") >= 0.34) & (F.col("pos") >= 20), F.lit("repeats")), F.when(F.col("monologue") >= 4, F.lit("monologue")),
    ))
    hits = p.where(F.col("pos") >= least).select("session_key", "pos", F.explode(reasons).alias("reason"))
    return hits.groupBy("session_key", "reason").agg(F.min("pos").alias("first_pos"))


def compactions(df: DataFrame, counts: Sequence[str], least: int = 8) -> DataFrame:
    """Rows at which one of the counts fell although it was ``least`` or more before, with the counts before."""
    w = ordered()
    fell = F.lit(False)
    for c in counts:
        df = df.withColumn(f"{c}_before", F.lag(c).over(w))
        fell = fell | F.coalesce((F.col(c) < F.col(f"{c}_before")) & (F.col(f"{c}_before") >= least), F.lit(False))
    return df.where(fell).select("session_key", "call_id", *[f"{c}_before" for c in counts])


def action_of(tool: Column) -> Column:
    """The kind of action a tool is; no tool is reasoning."""
    out = F.when(F.coalesce(tool, F.lit("")) == "", "reason")
    for action, tools in TOOL_ACTIONS.items():
        out = out.when(tool.isin(*tools), action)
    return out.otherwise("integrate")


def extension_class(path: Column) -> Column:
    """The class of a file by its ending; none without one."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.when(F.coalesce(ext, F.lit("")) == "", "none")
    for name, endings in EXTENSIONS.items():
        out = out.when(ext.isin(*endings), name)
    return out.otherwise("other")


def distinct_actions(calls: DataFrame) -> DataFrame:
    """0 for the first call of a session and the number of kinds, six, for all others; that is what models were trained on."""
    return positions(calls).select("call_id", F.when(F.col("pos") == 1, 0).otherwise(6).cast("long").alias("distinct_actions"))


def turn_window(turns: DataFrame, by: str, pos: str, role: str, most: int = 48) -> DataFrame:
    """The last ``most`` turns of each conversation, from a user's turn on.

    The window begins with the first user's turn in it; if there is none, with
    the last one before it; a longer conversation without any has no rows.
    """
    w = W.partitionBy(by)
    begin = F.max(pos).over(w) - most + 1
    t = turns.withColumn("__begin", begin).withColumn("__n", F.count("*").over(w))
    user = F.col(role) == "user"
    inside = F.min(F.when(user & (F.col(pos) >= F.col("__begin")), F.col(pos))).over(w)
    before = F.max(F.when(user & (F.col(pos) < F.col("__begin")), F.col(pos))).over(w)
    t = t.withColumn("__from", F.when(F.col("__n") > most, F.coalesce(inside, before)).otherwise(F.min(pos).over(w)))
    return t.where(F.col(pos) >= F.col("__from")).drop("__begin", "__n", "__from")


def ranked_fallback(groups: DataFrame, key: str) -> DataFrame:
    """The first group, by probability and then by its place, that has an eligible arm: key, grp, probability, place among all."""
    w = W.partitionBy(key).orderBy(F.desc("probability"), "ord")
    g = groups.withColumn("place", F.row_number().over(w).cast("long"))
    first = g.where("eligible").groupBy(key).agg(F.min(F.struct("place", "grp", "probability")).alias("f"))
    return first.select(key, "f.grp", "f.probability", "f.place")


def model_switches(df: DataFrame, by: str, ts: str, tie: str, model: str) -> DataFrame:
    """Turn count, whether the model ever changed, the last one and the streak of the same one, per row."""
    w = W.partitionBy(by).orderBy(ts, tie)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    changed = F.coalesce(F.lag(model).over(w) != F.col(model), F.lit(False))
    return df.withColumn("turn_count", F.row_number().over(w).cast("long")).withColumn("__c", changed).withColumn("has_ever_switched", F.bool_or("__c").over(upto)).withColumn("last_served_model", F.lag(model).over(w)).drop("__c")


def sessions(df: DataFrame, by: Sequence[str], ts: str, gap_seconds: int) -> DataFrame:
    """Sessions by a gap of silence: start, end and rows."""
    w = W.partitionBy(*by).orderBy(ts)
    new = F.coalesce(F.expr(f"timestampdiff(MICROSECOND, __p, {ts})") >= gap_seconds * 1_000_000, F.lit(True)).cast("int")
    s = df.withColumn("__p", F.lag(ts).over(w)).withColumn("__n", new).withColumn("__s", F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(*by, "__s").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")).drop("__s")
