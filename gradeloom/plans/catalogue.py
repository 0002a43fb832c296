"""Registered queries over the driver's tables, one for each operator, and their SQL.

The tables hold no evaluation records, so these are derived from ``events``:
sample_id is the user, gen_idx the position by time, score 1 for a purchase,
parsed a value over 10, and five groups. Texts are those of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions import extract as X
from gradeloom.functions import instructions as I
from gradeloom.functions import prompts as PR
from gradeloom.functions import text as T
from gradeloom.operators import following
from gradeloom.operators import metrics as M
from gradeloom.operators import plan as P
from gradeloom.plans import prepare as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


GROUPS = ("Physics (A)", "organic chem", "Law-1", "law 1", " - ")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, gen_idx, score, parsed, grp, event_id, value: all events of each user as generations."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("gen_idx", F.row_number().over(w) - 1)
    group = F.element_at(F.array(*map(F.lit, GROUPS)), (F.col("user_id") % 5 + 1).cast("int"))
    return e.select(F.col("user_id").alias("sample_id"), "gen_idx", (F.col("event_type") == "purchase").cast("double").alias("score"), (F.col("value") > 10).alias("parsed"), group.alias("grp"), "event_id", "value")


def _records() -> str:
    names = ", ".join(f"'{g}'" for g in GROUPS)
    return f"""records AS (SELECT user_id AS sample_id, CAST(g AS INT) AS gen_idx, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
      value > 10 AS parsed, ([{names}])[user_id % 5 + 1] AS grp, event_id, value
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS g FROM events))"""


RECORDS = _records()
SAMPLES = "samples AS (SELECT sample_id, count(*) AS n, CAST(sum(CASE WHEN score >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS c, avg(score) AS acc, avg(CASE WHEN parsed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS parsed, any_value(grp) AS grp FROM records GROUP BY sample_id)"
ERR = "CASE WHEN count({x}) > 1 THEN coalesce(stddev_samp({x}), 0) / sqrt(count({x})) ELSE 0 END"


def rounded(df: DataFrame) -> DataFrame:
    return df.select("metric", F.round("value", 9).alias("value"))


@query("sample_accuracy", f"WITH {RECORDS}, {SAMPLES} SELECT sample_id, n, c, round(acc, 9) AS acc FROM samples")
def sample_accuracy(spark, sf_dir):
    return M.per_sample(records(spark, sf_dir)).select("sample_id", "n", "c", F.round("acc", 9).alias("acc"))


@query(
    "accuracy_stderr",
    f"""WITH {RECORDS}, {SAMPLES}, x AS (SELECT avg(acc) AS a, {ERR.format(x='acc')} AS e, avg(parsed) AS p FROM samples)
    SELECT 'accuracy' AS metric, round(a, 9) AS value FROM x UNION ALL SELECT 'accuracy_stderr', round(e, 9) FROM x UNION ALL SELECT 'parsed_rate', round(p, 9) FROM x""",
)
def accuracy_stderr(spark, sf_dir):
    return rounded(M.accuracy(M.per_sample(records(spark, sf_dir), parsed=F.col("parsed"))))


def _pass_sql(ks: tuple[int, ...]) -> str:
    values = ", ".join(f"({k})" for k in ks)
    return f"""WITH {RECORDS}, {SAMPLES}, ks(k) AS (VALUES {values}), least_n AS (SELECT min(n) AS m FROM samples),
    p AS (SELECT k, CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0 ELSE 1.0 - (SELECT product(1.0 - k / CAST(i AS DOUBLE)) FROM range(CAST(n - c + 1 AS BIGINT), CAST(n + 1 AS BIGINT)) t(i)) END AS p
          FROM samples, ks, least_n WHERE k = 1 OR k <= m),
    g AS (SELECT k, avg(p) AS v, {ERR.format(x='p')} AS e FROM p GROUP BY k)
    SELECT 'pass@' || k AS metric, round(v, 9) AS value FROM g UNION ALL SELECT 'pass@' || k || '_stderr', round(e, 9) FROM g"""


@query("pass_at_k", _pass_sql((1, 2, 4, 8, 16)))
def pass_at_k(spark, sf_dir):
    return rounded(M.pass_metrics(M.per_sample(records(spark, sf_dir)), [1, 2, 4, 8, 16]))


@query("pass_k_gate", _pass_sql((1, 2, 32, 60)))
def pass_k_gate(spark, sf_dir):
    return rounded(M.pass_metrics(M.per_sample(records(spark, sf_dir)), [2, 32, 60]))


SLUG = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"


@query("accuracy_by_group", f"WITH {RECORDS}, {SAMPLES} SELECT 'accuracy_' || s AS metric, round(avg(acc), 9) AS value FROM (SELECT {SLUG.format(x='grp')} AS s, acc FROM samples) WHERE s <> '' GROUP BY s")
def accuracy_by_group(spark, sf_dir):
    return rounded(M.grouped(M.per_sample(records(spark, sf_dir), group=F.col("grp"))))


@query("binary_metrics")
def binary_metrics(spark, sf_dir):
    return rounded(M.binary_metrics(records(spark, sf_dir), parsed=F.col("parsed"), group=F.col("grp")))


@query(
    "first_record",
    f"""WITH {RECORDS}, f AS (SELECT *, round(value / 100, 6) AS cell, CASE WHEN {SLUG.format(x='grp')} = '' THEN 'unknown' ELSE {SLUG.format(x='grp')} END AS g FROM records WHERE gen_idx = 0),
    a AS (SELECT '' AS g, avg(score) AS p, avg(cell) AS c, avg(CAST(parsed AS INT)) AS r FROM f UNION ALL SELECT '_sub_' || g, avg(score), avg(cell), avg(CAST(parsed AS INT)) FROM f GROUP BY g)
    SELECT 'puzzle_accuracy' || g AS metric, round(p, 9) AS value FROM a UNION ALL SELECT 'cell_accuracy' || g, round(c, 9) FROM a UNION ALL SELECT 'parsed' || g, round(r, 9) FROM a""",
)
def first_record(spark, sf_dir):
    r = records(spark, sf_dir).select("sample_id", "gen_idx", "score", F.round(F.col("value") / 100, 6).alias("cell_accuracy"), F.col("parsed").cast("double").alias("parsed"), "grp")
    return rounded(M.grid_metrics(r, F.col("grp")))


FLAGS_SQL = """flags AS (SELECT doc_id // 4 AS sample_id, doc_id % 4 AS gen_idx, [text NOT LIKE '%,%', length(text) > 1000, doc_id % 3 = 0] AS s, [text NOT LIKE '%,%' OR lang = 'en', length(text) > 500, doc_id % 3 <> 1] AS l FROM documents)"""


@query(
    "micro_instruction",
    f"""WITH {FLAGS_SQL}, p AS (SELECT sample_id, avg(CASE WHEN s[1] AND s[2] AND s[3] THEN 1.0 ELSE 0.0 END) AS ps, avg(CASE WHEN l[1] AND l[2] AND l[3] THEN 1.0 ELSE 0.0 END) AS pl FROM flags GROUP BY 1),
    e AS (SELECT sample_id, unnest([1, 2, 3]) AS pos, unnest(s) AS s, unnest(l) AS l FROM flags), i AS (SELECT sample_id, pos, avg(CAST(s AS INT)) AS s, avg(CAST(l AS INT)) AS l FROM e GROUP BY 1, 2)
    SELECT 'prompt_level_strict_acc' AS metric, round(avg(ps), 9) AS value FROM p UNION ALL SELECT 'prompt_level_strict_acc_stderr', round({ERR.format(x='ps')}, 9) FROM p
    UNION ALL SELECT 'prompt_level_loose_acc', round(avg(pl), 9) FROM p UNION ALL SELECT 'prompt_level_loose_acc_stderr', round({ERR.format(x='pl')}, 9) FROM p
    UNION ALL SELECT 'inst_level_strict_acc', round(avg(s), 9) FROM i UNION ALL SELECT 'inst_level_strict_acc_stderr', round({ERR.format(x='s')}, 9) FROM i
    UNION ALL SELECT 'inst_level_loose_acc', round(avg(l), 9) FROM i UNION ALL SELECT 'inst_level_loose_acc_stderr', round({ERR.format(x='l')}, 9) FROM i""",
)
def micro_instruction(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n, i = F.length("text"), F.col("doc_id") % 3
    s = F.array(~F.col("text").contains(","), n > 1000, i == 0)
    l = F.array(~F.col("text").contains(",") | (F.col("lang") == "en"), n > 500, i != 1)  # noqa: E741
    every = lambda a: F.forall(a, lambda x: x)
    r = d.select(F.floor(F.col("doc_id") / 4).alias("sample_id"), F.lit(0.0).alias("score"), every(s).alias("strict"), every(l).alias("loose"), s.alias("strict_flags"), l.alias("loose_flags"), F.lit(3).alias("expected"))
    return rounded(M.instruction_metrics(r))


TASKS_SQL = f"""{RECORDS}, long AS (
  SELECT 'gen' || gen_idx AS task, 'accuracy' AS metric, avg(score) AS value FROM records GROUP BY gen_idx
  UNION ALL SELECT 'gen' || gen_idx, 'pass@1', avg(score) / 2 FROM records WHERE gen_idx % 2 = 0 GROUP BY gen_idx
  UNION ALL SELECT 'gen' || gen_idx, 'mean_value', avg(value) FROM records WHERE gen_idx < 3 GROUP BY gen_idx)"""


def task_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("task", F.concat(F.lit("gen"), F.col("gen_idx").cast("string")))
    per = r.groupBy("task", "gen_idx").agg(F.avg("score").alias("a"), F.avg("value").alias("v"))
    m = F.array(F.struct(F.lit("accuracy").alias("metric"), F.col("a").alias("value")), F.when(F.col("gen_idx") % 2 == 0, F.struct(F.lit("pass@1").alias("metric"), (F.col("a") / 2).alias("value"))), F.when(F.col("gen_idx") < 3, F.struct(F.lit("mean_value").alias("metric"), F.col("v").alias("value"))))
    return per.select("task", F.explode(F.filter(m, lambda x: x.isNotNull())).alias("m")).select("task", "m.metric", "m.value")


@query("run_metric_avg", f"WITH {TASKS_SQL} SELECT metric, round(avg(value), 9) AS value, count(DISTINCT task) AS num_tasks FROM long GROUP BY metric")
def run_metric_avg(spark, sf_dir):
    return M.run_averages(task_metrics(spark, sf_dir)).select("metric", F.round("value", 9).alias("value"), "num_tasks")


@query("primary_metric", f"WITH {TASKS_SQL} SELECT task, metric, round(value, 9) AS value FROM long QUALIFY row_number() OVER (PARTITION BY task ORDER BY CASE metric WHEN 'pass@1' THEN 1 WHEN 'accuracy' THEN 2 ELSE 99 END, metric) = 1")
def primary_metric(spark, sf_dir):
    return M.primary_metric(task_metrics(spark, sf_dir)).select("task", "metric", F.round("value", 9).alias("value"))


@query("primary_aggregate", f"WITH {TASKS_SQL}, p AS (SELECT value FROM long QUALIFY row_number() OVER (PARTITION BY task ORDER BY CASE metric WHEN 'pass@1' THEN 1 WHEN 'accuracy' THEN 2 ELSE 99 END, metric) = 1) SELECT round(avg(value), 9) AS primary_mean, count(*) AS num_tasks FROM p")
def primary_aggregate(spark, sf_dir):
    return M.primary_aggregate(M.primary_metric(task_metrics(spark, sf_dir))).select(F.round("primary_mean", 9).alias("primary_mean"), "num_tasks")


_WEIGHT = " + ".join(f"CAST(v >= {bound} AS INT)" for bound in M.POISSON)


@query(
    "bootstrap_ci",
    f"""WITH {RECORDS}, {SAMPLES}, d AS (SELECT b, acc AS x, md5('42:' || b || ':' || sample_id) AS h FROM samples, range(250) t(b)),
    w AS (SELECT b, j, x, {_WEIGHT} AS w FROM (SELECT b, j, x, CAST('0x' || substr(h, CAST(8 * j + 1 AS INT), 8) AS BIGINT) AS v FROM d, range(4) s(j))),
    m AS (SELECT sum(w * x) / sum(w) AS m FROM w GROUP BY b, j HAVING sum(w) > 0)
    SELECT (SELECT round(avg(acc), 9) FROM samples) AS mean, round(stddev_samp(m), 9) AS stderr, round(quantile_cont(m, 0.025), 9) AS ci_low, round(quantile_cont(m, 0.975), 9) AS ci_high FROM m""",
)
def bootstrap_ci(spark, sf_dir):
    s = M.per_sample(records(spark, sf_dir))
    return M.bootstrap_mean(s, "acc").select(*[F.round(c, 9).alias(c) for c in ("mean", "stderr", "ci_low", "ci_high")])


# --- planning ---------------------------------------------------------------------------


@query("grid_pending", f"WITH {RECORDS} SELECT u AS sample_id, CAST(g AS INT) AS gen_idx FROM (SELECT DISTINCT user_id AS u FROM events), range(100) t(g) EXCEPT SELECT sample_id, gen_idx FROM records WHERE parsed")
def grid_pending(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id")).distinct()
    done = records(spark, sf_dir).where("parsed")
    return P.pending(samples, done, 100)


@query("pending_by_sample", f"WITH {RECORDS}, p AS (SELECT u, g FROM (SELECT DISTINCT user_id AS u FROM events), range(100) t(g) EXCEPT SELECT sample_id, gen_idx FROM records) SELECT u AS sample_id, string_agg(g, ',' ORDER BY g) AS missing, CAST(count(*) AS INT) AS num_generations FROM p GROUP BY u")
def pending_by_sample(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id")).distinct()
    return P.pending_by_sample(P.pending(samples, records(spark, sf_dir), 100)).select("sample_id", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"), "num_generations")


@query("resume_filter", f"WITH {RECORDS} SELECT sample_id, gen_idx, score FROM records WHERE gen_idx BETWEEN 0 AND 7 AND sample_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def resume_filter(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("sample_id"))
    return P.resume(records(spark, sf_dir), known, 8).select("sample_id", "gen_idx", "score")


@query("keep_last", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def keep_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return P.keep_last(e, F.struct("ts", "event_id"), ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")


@query("sample_results", f"WITH {RECORDS} SELECT c_custkey AS sample_id, coalesce(string_agg(CAST(gen_idx AS VARCHAR) || ':' || CAST(CAST(score AS INT) AS VARCHAR), ' ' ORDER BY gen_idx), '') AS scores, CAST(count(gen_idx) AS INT) AS n FROM customer LEFT JOIN records ON c_custkey = sample_id GROUP BY c_custkey")
def sample_results(spark, sf_dir):
    samples = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"))
    r = P.sample_results(samples, records(spark, sf_dir).select("sample_id", "gen_idx", "score"))
    return r.select("sample_id", F.array_join(F.transform("records", lambda x: F.concat(x.gen_idx.cast("string"), F.lit(":"), x.score.cast("int").cast("string"))), " ").alias("scores"), F.size("records").alias("n"))


@query("duplicate_ids", "SELECT md5(text) AS sample_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return P.duplicate_ids(table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("sample_id")))


@query("union_existing_new", f"WITH {RECORDS} SELECT sample_id, gen_idx, score, CAST(NULL AS VARCHAR) AS note FROM records WHERE gen_idx < 4 UNION ALL SELECT sample_id, gen_idx, score, 'new' FROM records WHERE gen_idx >= 12")
def union_existing_new(spark, sf_dir):
    r = records(spark, sf_dir).select("sample_id", "gen_idx", "score")
    return P.union_records(r.where("gen_idx < 4").withColumn("note", F.lit(None).cast("string")), r.where("gen_idx >= 12").withColumn("note", F.lit("new")))


@query("summary_merge", "WITH n AS (SELECT o_custkey AS task, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), o AS (SELECT o_custkey AS task, count(*) AS v FROM orders GROUP BY 1) SELECT * FROM n UNION ALL SELECT * FROM o WHERE task NOT IN (SELECT task FROM n)")
def summary_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), "o_orderstatus")
    count = lambda d: d.groupBy("task").agg(F.count("*").alias("v"))
    return P.merge_summaries(count(o.where("o_orderstatus = 'F'")), count(o))


@query("round_robin", "SELECT doc_id, doc_id % 3 AS worker FROM documents")
def round_robin(spark, sf_dir):
    return P.round_robin(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 3)


@query("n_bucket", f"WITH {RECORDS}, b AS (SELECT sample_id, CAST(count(*) AS INT) AS num_generations FROM records WHERE parsed GROUP BY 1) SELECT num_generations, count(*) AS prompts FROM b GROUP BY 1")
def n_bucket(spark, sf_dir):
    r = records(spark, sf_dir).where("parsed").groupBy("sample_id").agg(F.count("*").cast("int").alias("num_generations"))
    return r.groupBy("num_generations").agg(F.count("*").alias("prompts"))


TURNS = "turns AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS g, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))))
    return c.groupBy("conv_id").agg(m.alias("m"))


@query("pad_generations", f"WITH {TURNS} SELECT conv_id, array_to_string(list_transform(list_resize(g, 4, ''), lambda x: md5(x)), ' ') AS padded FROM turns")
def pad_generations(spark, sf_dir):
    t = turns(spark, sf_dir).select("conv_id", P.pad_generations(F.transform("m", lambda x: x.content), 4).alias("g"))
    return t.select("conv_id", F.array_join(F.transform("g", lambda x: F.md5(x.cast("binary"))), " ").alias("padded"))


@query("render_prompt", "SELECT conv_id, md5(string_agg(CASE WHEN role = 'system' THEN 'user' ELSE role END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS prompt, CAST(count(*) AS INT) AS n FROM conversations GROUP BY conv_id")
def render_prompt(spark, sf_dir):
    blank = lambda x: F.struct(F.when(x.role == "system", " \t").otherwise(x.role).alias("role"), x.content.alias("content"))
    t = turns(spark, sf_dir).select("conv_id", PR.normalise(F.transform("m", blank)).alias("m"))
    return t.select("conv_id", F.md5(PR.render(F.col("m")).cast("binary")).alias("prompt"), F.size("m").alias("n"))


@query("inspect_prompts", "SELECT doc_id AS sample_id, 'user: ' || text AS prompt FROM documents ORDER BY doc_id LIMIT 5")
def inspect_prompts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "text")
    return P.inspect(d, PR.render(PR.user(F.col("text"))), 5)


@query("run_id", "SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(regexp_extract(rtrim(url, '/'), '[^/]*$')), '[^a-z0-9._-]+', '-', 'g'), '-'), ''), 'model') AS run_id FROM pages")
def run_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.run_id(F.col("url")).alias("run_id"))


@query("slugify", f"SELECT DISTINCT p_type, {SLUG.format(x='p_type')} AS slug FROM part")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type").distinct().select("p_type", T.slugify(F.col("p_type")).alias("slug"))


# --- extraction: documents with a closing line by doc_id ------------------------------------

ENDINGS = ("Final answer: (C).", "I think the correct option is B.", "answer: d", "Answer: because of it.", "So we pick (a) here", "the answer is a good one", "nothing at all")


def replies(spark: SparkSession, sf_dir: str, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    end = F.element_at(F.array(*map(F.lit, endings)), (F.col("doc_id") % len(endings) + 1).cast("int"))
    return d.select("doc_id", F.concat("text", F.lit("\n"), end).alias("reply"))


def _replies(endings: tuple[str, ...] = ENDINGS) -> str:
    items = ", ".join("'" + e.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for e in endings)
    return f"replies AS (SELECT doc_id, text || chr(10) || ([{items}])[doc_id % {len(endings)} + 1] AS reply FROM documents)"


def _choice_sql() -> str:
    # boundaries as consumed groups: this engine has no lookaround
    letter = "(?:^|[^A-Za-z0-9])\\(?([A-D])\\)?(?:[^A-Za-z0-9]|$)"
    steps = [
        ("final_answer", f"(?is)final\\s+answer(?:\\s+is)?\\s*[:：]?\\s*?{letter}"),
        ("answer_colon", f"(?is)(?:^|\\W)answer\\s*[:：]\\s*?{letter}"),
        ("answer_anchor", f"(?i)(?:^|\\W)answer(?:\\b.{{0,80}}?)??{letter}"),
        ("option_anchor", f"(?is)(?:^|\\W)(?:option|choice)\\b(?:\\s+is)?\\s*?{letter}"),
        ("select_anchor", f"(?i)(?:^|\\W)(?:choose|chosen|select|selected|pick|picked)\\b.{{0,40}}?{letter}"),
        ("line_start", f"(?im)^\\s*(?:\\*\\*)?\\s*\\(?([A-D])\\)?(?:\\*\\*)?\\s*(?:[\\)\\].,:]|$)"),
    ]
    cols = ", ".join(f"list_extract(regexp_extract_all(t, '{p}', 1), -1) AS v{i}" for i, (_, p) in enumerate(steps))
    how = " ".join(f"WHEN v{i} <> '' THEN '{n}'" for i, (n, _) in enumerate(steps))
    what = ", ".join(f"nullif(v{i}, '')" for i in range(len(steps)))
    return f"WITH {_replies()}, x AS (SELECT doc_id, {cols} FROM (SELECT doc_id, right(reply, 1000) AS t FROM replies)) SELECT doc_id, upper(coalesce({what})) AS prediction, CASE {how} ELSE 'none' END AS extract_method, CASE WHEN upper(coalesce({what})) = 'C' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM x"


@query("mcq_extract", _choice_sql())
def mcq_extract(spark, sf_dir):
    r = replies(spark, sf_dir).select("doc_id", X.score_choice(F.col("reply"), F.lit("C")).alias("r"))
    return r.select("doc_id", "r.prediction", "r.extract_method", "r.score")


@query("mcq_tail", "SELECT doc_id, length(right(text, 1000)) AS n, md5(right(text, 1000)) AS tail FROM documents")
def mcq_tail(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.tail(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5(F.col("t").cast("binary")).alias("tail"))


TEMPLATE_ENDINGS = ("Therefore, the answer is (D).", "therefore the answer is: b", "The correct answer is: C", "The answer is A.")


@query(
    "template_ladder",
    f"""WITH {_replies(TEMPLATE_ENDINGS)}, x AS (SELECT doc_id, doc_id % 4 AS m FROM replies)
    SELECT doc_id, CASE m WHEN 0 THEN 'D' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'A' END AS prediction, CASE m WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS form FROM x""",
)
def template_ladder(spark, sf_dir):
    r = replies(spark, sf_dir, TEMPLATE_ENDINGS).select("doc_id", X.score_template(F.col("reply"), F.lit("D")).alias("r"))
    return r.select("doc_id", "r.prediction", F.col("r.answer_format_correct").alias("form"))


@query("bbh_normalise", "SELECT doc_id, md5(translate(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', '')) AS norm FROM documents")
def bbh_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalise_answer(F.col("text")).cast("binary")).alias("norm"))


@query("subset_answers")
def subset_answers(spark, sf_dir):
    ends = ("So the answer is (B).", "so the answer is True.", "answer: 42", "the answer is [ ] >")
    names = F.array(*map(F.lit, ("date_understanding", "boolean_expressions", "object_counting", "dyck_languages")))
    gold = F.array(*map(F.lit, ("(B)", "true", "42", "[ ] >")))
    i = (F.col("doc_id") % 4 + 1).cast("int")
    r = replies(spark, sf_dir, ends).select("doc_id", X.score_subset(F.right("reply", F.lit(300)), F.element_at(names, i), F.element_at(gold, i)).alias("r"))
    return r.select("doc_id", "r.prediction", "r.extract_method", "r.score")


FENCES = ("no code", "```python\nprint(1)\n```", "```\na\n```\nthen\n```py\nb = 2\nc\n```", "``` only one")


@query("fence_extract", "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'print(1)' WHEN 2 THEN 'b = 2' || chr(10) || 'c' ELSE '' END AS code, CASE WHEN doc_id % 4 IN (1, 2) THEN 'fenced_code' ELSE 'no_fenced_code' END AS extract_method FROM documents")
def fence_extract(spark, sf_dir):
    r = replies(spark, sf_dir, FENCES)
    code, method = X.last_fence(F.col("reply"))
    return r.select("doc_id", code.alias("code"), method.alias("extract_method"))


@query("function_code")
def function_code(spark, sf_dir):
    ends = ("```python\ndef add(a, b):\n    return a + b\n```", "    return a + b", "Here is the completed function:\n```python\n    return 1\n```")
    r = replies(spark, sf_dir, ends)
    code, full = X.complete_function(F.lit("def add(a, b):\n"), F.lit("add"), F.col("reply"))
    return r.select("doc_id", F.md5(code.cast("binary")).alias("code"), full.alias("is_full_solution"))


@query(
    "zebra_cells",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS parsed, CAST(CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INT) AS correct_cells, CASE WHEN p_size % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part",
)
def zebra_cells(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cells = lambda brand, kind: F.to_json(F.map_from_arrays(F.array(F.lit("House 1")), F.array(F.struct(brand.alias("Brand"), kind.alias("Type")))))
    gold = cells(F.col("p_brand"), F.col("p_type"))
    said = cells(F.concat(F.lit(" "), F.upper("p_brand")), F.when(F.col("p_size") % 3 == 0, F.lower("p_type")).otherwise("other"))
    text = F.when(F.col("p_size") % 3 == 2, F.lit("no {json}")).otherwise(F.concat(F.lit('so {x} {"solution": '), said, F.lit("} end")))
    r = p.select("p_partkey", X.grid_score_udf(text, gold, F.lit(2)).alias("r"))
    return r.select("p_partkey", "r.parsed", "r.correct_cells", "r.score")


@query("math_answers", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM orders")
def math_answers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    text = F.when(n % 3 == 0, F.concat(F.lit("thus \\boxed{0"), n, F.lit("}"))).when(n % 3 == 1, F.concat(F.lit("the answer is "), n, F.lit(".0"))).otherwise(F.concat(F.lit("\\boxed{"), n + 1, F.lit("}")))
    return o.select("o_orderkey", X.math_score_udf(text, n.cast("string")).alias("r")).select("o_orderkey", "r.score")


@query("code_exec")
def code_exec(spark, sf_dir):
    from gradeloom.operators.codeexec import run_tests_udf

    n = table(spark, sf_dir, "region").select("r_regionkey")
    code = F.when(F.col("r_regionkey") % 2 == 0, "print(int(input()) * 2)").otherwise("print('no')")
    r = n.select("r_regionkey", run_tests_udf(code, F.array(F.lit("2"), F.lit("5")), F.array(F.lit("4"), F.lit("10")), F.lit(None).cast("string"), F.lit(6.0)).alias("r"))
    return r.select("r_regionkey", "r.score", "r.passed_tests", "r.num_tests")


# --- data preparation --------------------------------------------------------------------


@query("gold_index", "SELECT p_partkey, substr('ABCDEFGHIJ', CASE WHEN p_size % 5 = 4 THEN 4 ELSE p_size % 5 + 1 END, 1) AS answer FROM part")
def gold_index(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", E.letter(E.gold_index((F.col("p_size") % 5), F.lit(4))).alias("answer"))


@query(
    "mmlu_reindex",
    "WITH x AS (SELECT p_partkey, p_size % 3 AS i, [p_brand, CASE WHEN p_size % 2 = 0 THEN 'N/A' ELSE p_type END, p_name] AS o FROM part) SELECT p_partkey, CAST(CASE WHEN o[i + 1] = 'N/A' THEN 2 WHEN i = 2 AND o[2] = 'N/A' THEN 1 ELSE i END AS INT) AS answer_index, CAST(len(list_filter(o, lambda v: v <> 'N/A')) AS INT) AS n FROM x",
)
def mmlu_reindex(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    options = F.array("p_brand", F.when(F.col("p_size") % 2 == 0, " n/a ").otherwise(F.col("p_type")), F.col("p_name"))
    kept, at = E.reindex(options, F.col("p_size") % 3, F.lit("c"))
    return p.select("p_partkey", at.alias("answer_index"), F.size(kept).alias("n"))


@query("json_lines", "SELECT event_id, props IS NOT NULL AND json_valid(props) AND json_type(props) = 'OBJECT' AS ok FROM events")
def json_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    return e.select("event_id", F.json_object_keys("value").isNotNull().alias("ok"))


@query("tier_report", "WITH f AS (SELECT event_type || ':' || (user_id % 3) AS id, value > 10 AS ok FROM events) SELECT 0 AS tier, split_part(id, ':', 1) AS name, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total FROM f GROUP BY 2 UNION ALL SELECT 1, id, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT), count(*) FROM f GROUP BY 2")
def tier_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(":"), (F.col("user_id") % 3).cast("string")).alias("instruction_id"), (F.col("value") > 10).alias("followed"))
    return M.tier_report(e).select("tier", "name", "correct", "total")


# --- instructions over documents -----------------------------------------------------------

WORDS_SQL = "len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+'))"
SPLIT_SQL = "list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')"
PUNCT_SQL = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
BARE_SQL = f"translate(text, {PUNCT_SQL}, '')"
TOKENS_SQL = f"list_filter(string_split_regex({BARE_SQL}, '[ \\t\\n\\r]+'), lambda x: x <> '')"
LOW_SQL = f"list_filter(string_split_regex(lower({BARE_SQL}), '[ \\t\\n\\r]+'), lambda x: x <> '')"

#: id: (arguments as JSON, SQL condition on text, or None)
INSTRUCTIONS: dict[str, tuple[str, str | None]] = {
    "keywords:existence": ('{"keywords": ["the", "an"]}', "regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)an')"),
    "keywords:frequency": ('{"keyword": "on", "frequency": 20, "relation": "at least"}', "len(regexp_extract_all(text, '(?i)on')) >= 20"),
    "keywords:forbidden_words": ('{"forbidden_words": ["idiot", "clown"]}', "NOT regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}\\p{M}_])(idiot|clown)([^\\p{L}\\p{N}\\p{M}_]|$)')"),
    "keywords:letter_frequency": ('{"letter": "e", "let_frequency": 100, "let_relation": "less than"}', "length(lower(text)) - length(replace(lower(text), 'e', '')) < 100"),
    "length_constraints:number_words": ('{"num_words": 200, "relation": "at least"}', f"{WORDS_SQL} >= 200"),
    "length_constraints:number_paragraphs": ('{"num_paragraphs": 1}', "text NOT LIKE '%***%'"),
    "length_constraints:nth_paragraph_first_word": ('{"num_paragraphs": 1, "nth_paragraph": 1, "first_word": "the"}', None),
    "detectable_content:number_placeholders": ('{"num_placeholders": 1}', "regexp_matches(text, '\\[[^\\n]*?\\]')"),
    "detectable_content:postscript": ('{"postscript_marker": "licensed"}', "lower(text) LIKE '%licensed%'"),
    "detectable_format:number_bullet_lists": ('{"num_bullets": 0}', "NOT regexp_matches(text, '(?m)^\\s*(\\*[^*]|-)')"),
    "detectable_format:constrained_response": ("{}", "text LIKE '%My answer is yes.%'"),
    "detectable_format:number_highlighted_sections": ('{"num_highlights": 1}', None),
    "detectable_format:multiple_sections": ('{"section_spliter": "SECTION", "num_sections": 1}', "regexp_matches(text, 'SECTION\\s?[0-9]+')"),
    "detectable_format:title": ("{}", "text LIKE '%<<%>>%'"),
    "combination:two_responses": ("{}", "text LIKE '%******%'"),
    "combination:repeat_prompt": ('{"prompt_to_repeat": "The and"}', "starts_with(lower(trim(text)), 'the and')"),
    "startend:end_checker": ('{"end_phrase": "the."}', "ends_with(lower(trim(trim(text, ' ' || chr(10) || chr(9)), '\"')), 'the.')"),
    "startend:quotation": ("{}", "length(text) > 1 AND text LIKE '\"%\"'"),
    "punctuation:no_comma": ("{}", "text NOT LIKE '%,%'"),
    "multi-turn:constrained_start": ('{"starter": "The"}', "regexp_matches(text, '(?m)^\\s*The')"),
    "count:word_count_range": ('{"min_words": 100, "max_words": 300}', f"{WORDS_SQL} BETWEEN 100 AND 300"),
    "count:unique_word_count": ('{"N": 150}', f"len(list_distinct(list_transform(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> ''), lambda x: trim(x, {PUNCT_SQL} || ' ')))) >= 150"),
    "count:conjunctions": ('{"small_n": 2}', f"len(list_distinct(list_filter({SPLIT_SQL}, lambda x: list_contains(['and', 'but', 'for', 'nor', 'or', 'so', 'yet'], lower(trim(x, {PUNCT_SQL} || ' ')))))) >= 2"),
    "count:person_names": ('{"N": 0}', "true"),
    "count:numbers": ('{"N": 0}', f"NOT regexp_matches({BARE_SQL}, '[0-9]')"),
    "words:vowel": ("{}", "instr(trim(text, ' ' || chr(10)), chr(10)) = 0 AND len(list_distinct(regexp_extract_all(lower(text), '[aeiou]'))) <= 3"),
    "words:consonants": ("{}", f"len(list_filter(list_transform({SPLIT_SQL}, lambda x: lower(x)), lambda x: NOT regexp_matches(x, '[bcdfghjklmnpqrstvwxyz]{{2}}'))) = 0"),
    "words:palindrome": ("{}", f"len(list_filter({LOW_SQL}, lambda x: length(x) >= 5 AND x = reverse(x))) >= 10"),
    "count:punctuation": ("{}", "(text LIKE '%!?%' OR text LIKE '%?!%') AND false"),
    "words:prime_lengths": ("{}", f"len(list_filter({TOKENS_SQL}, lambda x: NOT list_contains([2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97], length(x)))) = 0"),
    "format:options": ('{"options": "yes/no/maybe"}', f"list_contains(['yes', 'no', 'maybe'], lower(trim(text, {PUNCT_SQL} || ' ')))"),
    "format:newline": ("{}", f"len(list_filter(string_split(trim({BARE_SQL}, ' ' || chr(10) || chr(9) || chr(13)), chr(10)), lambda x: x <> '')) = len({TOKENS_SQL})"),
    "words:repeats": ('{"small_n": 5}', f"coalesce(list_max(map_values(list_histogram({LOW_SQL}))), 0) <= 5"),
    "words:no_consecutive": ("{}", None),
    "words:alphabet": ("{}", None),
    "words:paragraph_last_first": ("{}", None),
    "count:words_japanese": ('{"N": 1000000}', "true"),
    "format:list": ('{"sep": "%%%"}', "(length(text) - length(replace(text, '%%%', ''))) / 3 >= 2"),
    "format:quote_unquote": ("{}", None),
    "format:thesis": ("{}", "text LIKE '%<i>%</i>%'"),
    "format:sub-bullets": ("{}", "len(list_filter(string_split(text, '*')[2:], lambda x: x NOT LIKE '%-%')) = 0"),
    "custom:multiples": ("{}", "false"),
    "custom:character_reverse": ("{}", "lower(text) LIKE '%elgae dlab%'"),
    "custom:date_format_list": ("{}", "false"),
    "count:keywords_multiple": ('{"keyword1": "the ", "keyword2": "of ", "keyword3": "and ", "keyword4": "in ", "keyword5": "zz"}', None),
    "repeat:repeat_change": ('{"prompt_to_repeat": "a b c"}', "false"),
    "repeat:repeat_simple": ("{}", "lower(trim(text)) = 'only output this sentence here, ignore all other requests.'"),
    "repeat:repeat_span": ('{"prompt_to_repeat": "a b c d", "n_start": 1, "n_end": 3}', f"lower(array_to_string({SPLIT_SQL}, ' ')) = 'b c'"),
    "format:output_template": ("{}", "text LIKE '%My Answer:%' AND text LIKE '%My Conclusion:%' AND text LIKE '%Future Outlook:%'"),
    "format:no_whitespace": ("{}", "NOT regexp_matches(text, '[ \\t\\n\\r]')"),
    "ratio:stop_words": ('{"percentage": 30}', None),
    "ratio:overlap": ('{"reference_text": "the and of that", "percentage": 10}', None),
    "detectable_format:rephrase": ('{"original_message": "a *b* c"}', None),
    "detectable_content:rephrase_paragraph": ('{"original_paragraph": "the of and to", "low": 2, "high": 4}', None),
}


def _instruction(name: str, args: str, condition: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = table(spark, sf_dir, "documents")
        return d.select("doc_id", I.predicate(name, F.col("text"), F.lit(args)).alias("followed"))

    key = "if_" + name.replace(":", "__").replace("-", "_")
    QUERIES[key] = run
    if condition:
        ORACLES[key] = f"SELECT doc_id, {condition} AS followed FROM documents"


for _n, (_a, _c) in INSTRUCTIONS.items():
    _instruction(_n, _a, _c)


@query(
    "ngram_overlap",
    """WITH b AS (SELECT text AS ref FROM benchmark ORDER BY item_id LIMIT 1), t AS (SELECT doc_id, list_distinct([substr(text, i, 3) for i in range(1, length(text) - 1)]) AS g FROM documents),
    r AS (SELECT list_distinct([substr(ref, i, 3) for i in range(1, length(ref) - 1)]) AS g FROM b)
    SELECT doc_id, round(len(list_intersect(t.g, r.g)) * 100.0 / len(t.g), 9) AS overlap FROM t, r""",
)
def ngram_overlap(spark, sf_dir):
    ref = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(F.col("text").alias("ref"))
    d = table(spark, sf_dir, "documents").crossJoin(F.broadcast(ref))  # one row
    return d.select("doc_id", F.round(I.overlap(F.col("text"), F.col("ref")), 9).alias("overlap"))


STRICT_LOOSE = ("punctuation:no_comma", "keywords:forbidden_words")


@query(
    "if_strict_loose",
    """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
    p AS (SELECT doc_id, text, ls, len(ls) AS n FROM d),
    v AS (SELECT doc_id, text AS raw, unnest([text, trim(array_to_string(ls[2:], chr(10)), ' ' || chr(10) || chr(9)), trim(array_to_string(ls[:n - 1], chr(10)), ' ' || chr(10) || chr(9)), trim(array_to_string(ls[2:n - 1], chr(10)), ' ' || chr(10) || chr(9))]) AS x FROM p),
    w AS (SELECT doc_id, raw, x FROM v UNION ALL SELECT doc_id, raw, replace(x, '*', '') FROM v),
    f AS (SELECT doc_id, trim(raw) <> '' AND raw NOT LIKE '%,%' AS s1, trim(raw) <> '' AND raw NOT LIKE '%|%' AND raw NOT ILIKE '%clown%' AS s2, trim(x) <> '' AND x NOT LIKE '%,%' AS l1, trim(x) <> '' AND NOT regexp_matches(x, '(?i)(^|[^\\p{L}\\p{N}\\p{M}_])clown([^\\p{L}\\p{N}\\p{M}_]|$)') AS l2,
          trim(raw) <> '' AND NOT regexp_matches(raw, '(?i)(^|[^\\p{L}\\p{N}\\p{M}_])clown([^\\p{L}\\p{N}\\p{M}_]|$)') AS t2 FROM w)
    SELECT doc_id AS sample_id, bool_or(s1) AND bool_or(t2) AS strict, bool_or(l1) AND bool_or(l2) AS loose FROM f GROUP BY doc_id""",
)
def if_strict_loose(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.lit(0).alias("gen_idx"), F.col("text").alias("generation"), F.array(*map(F.lit, STRICT_LOOSE)).alias("instruction_ids"), F.array(F.lit("{}"), F.lit('{"forbidden_words": ["clown"]}')).alias("kwargs"))
    return following.evaluate(d, list(STRICT_LOOSE)).select("sample_id", "strict", "loose")


PYTHON_ARGS = '{"language": "en", "num_sentences": 3, "relation": "at least", "key_sentences": ["a"], "capital_frequency": 3, "capital_relation": "at least", "word": "the", "N": 1, "small_n": 1, "keyword": "the", "n": 1, "m": 1}'


@query("if_python_predicates")
def if_python_predicates(spark, sf_dir):
    names = F.array(*map(F.lit, sorted(I.py.PREDICATES)))
    told = I.py.follow_many_udf("text", names, F.transform(names, lambda _: F.lit(PYTHON_ARGS)))
    d = table(spark, sf_dir, "documents").select("doc_id", told.alias("told"))
    return d.select("doc_id", F.explode(F.arrays_zip(names.alias("name"), F.col("told").alias("followed"))).alias("z")).select("doc_id", "z.name", "z.followed").groupBy("name").agg(F.count_if("followed").alias("followed"), F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of the derived records in one table."""
    return QUERIES["binary_metrics"](spark, sf_dir)
