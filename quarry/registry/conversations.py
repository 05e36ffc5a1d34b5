"""Conversation, memory, trace and cache queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.vectors import hash_embedding
from quarry.operators import catalog, context, matching, memory, traces
from quarry.operators.ordered import position
from quarry.registry.catalog import query, table
from quarry.registry.search import HASH_COSINE_SQL, label_centroids, CENTROIDS_SQL, top_sql


def messages(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("index"), "role", F.col("text").alias("content"))


@query("A10", """WITH m AS (SELECT conv_id, count(*) AS message_count, first(substr(text, 1, 100) ORDER BY turn) FILTER (text <> '') AS preview FROM conversations GROUP BY 1)
SELECT conv_id AS conversation_id, CASE WHEN conv_id % 3 = 0 THEN '未命名对话' ELSE 'talk ' || conv_id END AS title, message_count, coalesce(preview, '') AS preview FROM m""")
def conversation_listing(spark, sf):
    """Threads with message count, preview and default title."""
    m = messages(spark, sf)
    headers = m.select("conversation_id").distinct().select(
        "conversation_id", F.when(F.col("conversation_id") % 3 != 0, F.concat(F.lit("talk "), F.col("conversation_id").cast("string"))).alias("title"),
        F.col("conversation_id").alias("updated_at"))
    return catalog.conversation_listing(m, headers).select("conversation_id", "title", "message_count", "preview")


@query("W10 F21", """WITH q AS (SELECT conv_id, last(text ORDER BY turn) AS query FROM conversations WHERE role = 'user' GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT c.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations c)
SELECT conv_id AS conversation_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || '：' || text, chr(10) ORDER BY turn) AS history
FROM r JOIN q USING (conv_id) WHERE rn <= 4 AND NOT (role = 'user' AND text = query) GROUP BY 1""")
def recent_turns(spark, sf):
    """Last four turns of each thread without its last user message."""
    m = messages(spark, sf)
    last = m.filter("role = 'user'").groupBy("conversation_id").agg(F.max_by("content", "index").alias("query"))
    return memory.recent_turns(m, last, 4)


FOLD = "list_append(a, m)"
FOLD_KEEP = f"least(2, len({FOLD}) - 1)"


@query("T1", f"""WITH g AS (SELECT conv_id, list({{'role': role, 'content': text}} ORDER BY turn) AS ms FROM conversations GROUP BY 1),
f AS (SELECT conv_id, list_reduce(ms, lambda a, m: CASE
  WHEN (len({FOLD}) <= 4 AND list_sum(list_transform({FOLD}, lambda x: greatest(1, length(x.content) // 4))) <= 300) OR len({FOLD}) < 2 THEN {FOLD}
  ELSE list_concat([{{'role': 'system', 'content': '[历史摘要]' || chr(10) || substr(array_to_string(list_transform({FOLD}[1:len({FOLD}) - {FOLD_KEEP}],
    lambda x: x.role || ': ' || x.content), chr(10)), 1, 2000)}}], {FOLD}[len({FOLD}) - {FOLD_KEEP} + 1:len({FOLD})]) END,
  []::STRUCT("role" VARCHAR, content VARCHAR)[]) AS s FROM g)
SELECT conv_id AS conversation_id, unnest(range(0, len(s)))::INT AS index, unnest(list_transform(s, lambda x: x.role)) AS role,
unnest(list_transform(s, lambda x: x.content)) AS content FROM f""")
def memory_window(spark, sf):
    """Memory of every thread with a window of 4 messages and 300 tokens."""
    return memory.memory_window(messages(spark, sf), 4, 300)


@query("W11 T9", """WITH s AS (SELECT conv_id, 0 AS source, turn AS position, substr(text, 1, 200) AS snippet FROM conversations WHERE role <> 'assistant'
UNION ALL SELECT conv_id, 1, -turn, substr(text, 1, 200) FROM conversations WHERE role = 'assistant' AND turn % 4 <> 1)
SELECT conv_id AS session_id, rank, snippet FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY source, position, snippet) AS rank FROM s) WHERE rank <= 5""")
def memory_snippets(spark, sf):
    """Five snippets per thread: user turns, then remembered answers."""
    m = messages(spark, sf).withColumnRenamed("conversation_id", "session_id")
    items = m.filter("role = 'assistant'").withColumn("memory_id", F.concat_ws(":", "session_id", "index"))
    items = memory_forget(items)
    return memory.snippets(m.filter("role <> 'assistant'").withColumn("position", F.col("index")),
                           items.withColumn("position", -F.col("index")), 5).select("session_id", "rank", "snippet")


def memory_forget(items):
    return catalog.forget(items, items.filter("index % 4 = 1").select("memory_id"))


@query("V2 T9", f"""WITH {CENTROIDS_SQL}, l2 AS (SELECT q.query_id, c.id, round(pow(list_distance(q.vec, c.vec), 2), 9) AS score FROM q JOIN c ON c.label = q.query_id)
SELECT query_id, id, rank, round(score, 6) AS score FROM ({top_sql('l2', 5, 'score, id')})""")
def memory_recall(spark, sf):
    """Five nearest memories per session: sessions are the labels."""
    emb = table(spark, sf, "embeddings")
    items = emb.select(F.col("vec_id").alias("memory_id"), F.col("label").alias("session_id"), F.col("embedding").alias("vector"))
    q = label_centroids(emb).withColumn("session_id", F.col("query_id"))
    return memory.recall(items, q).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("A15 F24", """WITH u AS (SELECT CASE WHEN role = 'assistant' THEN 0 ELSE greatest(1, length(text) // 4) END AS p, CASE WHEN role = 'assistant' THEN greatest(1, length(text) // 4) ELSE 0 END AS c FROM conversations),
t AS (SELECT count(*) AS requests, sum(p + c)::BIGINT AS total_tokens, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens FROM u)
SELECT *, round(prompt_tokens / 1e6::DOUBLE * 0.27 + completion_tokens / 1e6::DOUBLE * 1.10, 4) AS cost, round(prompt_tokens / (prompt_tokens + completion_tokens) * 100)::BIGINT AS prompt_pct,
round(completion_tokens / (prompt_tokens + completion_tokens) * 100)::BIGINT AS completion_pct FROM t""")
def usage_cost(spark, sf):
    """Tokens, cost and shares over all messages."""
    return traces.usage_totals(usage_rows(messages(spark, sf)))


def usage_rows(m):
    n = tx.approx_tokens(F.col("content"))
    made = F.col("role") == "assistant"
    return m.select(F.when(made, 0).otherwise(n).alias("prompt_tokens"),
                    F.when(made, n).otherwise(0).alias("completion_tokens"), n.alias("total_tokens"))


@query("T8", """WITH last AS (SELECT conv_id, role, text, turn FROM conversations WHERE conv_id % 2 = 0 AND turn % 2 = 0)
SELECT conv_id AS conversation_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS index, role, 'new ' || text AS content FROM last
UNION ALL SELECT conv_id, turn::INT, role, text FROM conversations WHERE conv_id % 2 = 1""")
def saved_conversations(spark, sf):
    """Even threads saved twice; the later payload replaces their messages."""
    m = messages(spark, sf)
    even = m.filter("conversation_id % 2 = 0")
    body = lambda df, text: df.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "index", "role", text.alias("content")))), lambda s: F.struct(s["role"].alias("role"), s["content"].alias("content"))).alias("messages"))
    first = body(even, F.col("content")).select("conversation_id", F.lit("a").alias("title"), "messages", F.lit(1).alias("saved_at"))
    second = body(even.filter("index % 2 = 0"), F.concat(F.lit("new "), "content")).select(
        "conversation_id", F.lit("b").alias("title"), "messages", F.lit(2).alias("saved_at"))
    headers = m.select("conversation_id").distinct().select("conversation_id", F.lit("x").alias("title"), F.lit(0).alias("updated_at"))
    _, saved = catalog.save_conversations(headers, m.withColumn("index", F.col("index").cast("int")), first.unionByName(second))
    return saved


# --- traces: one per user and day -----------------------------------------------------

def trace_events(spark, sf):
    """Events as trace events; the last event of a finished trace closes it."""
    return as_trace_events(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))


def as_trace_events(e):
    e = e.withColumn("trace_id", F.md5(F.concat_ws("|", "user_id", F.to_date("ts"))))
    name = (F.when(F.col("event_type") == "signup", "span.start").when(F.col("event_type") == "purchase", "span.end")
            .when(F.col("event_type") == "click", "react.step").when(F.col("event_type") == "error", "plan_execute")
            .otherwise("note"))
    return e.select("trace_id", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("session_id"), "event_id", "ts",
                    name.alias("name"), F.col("event_type").alias("phase"), F.col("props").alias("payload"),
                    F.col("value").cast("int").alias("duration_ms"),
                    F.when(F.col("value") > 50, F.concat(F.lit("slow "), F.col("event_type"))).alias("error"))


TRACE_SQL = """ev AS (SELECT md5(concat_ws('|', user_id, strftime(ts, '%Y-%m-%d'))) AS trace_id, 'user' || user_id AS session_id, event_id, ts,
    CASE event_type WHEN 'signup' THEN 'span.start' WHEN 'purchase' THEN 'span.end' WHEN 'click' THEN 'react.step' WHEN 'error' THEN 'plan_execute' ELSE 'note' END AS name,
    event_type AS phase, props AS payload, trunc(value)::INT AS duration_ms, CASE WHEN value > 50 THEN 'slow ' || event_type END AS error FROM events),
  st AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS index FROM ev WHERE name IN ('react.step', 'plan_execute')),
  rec AS (SELECT trace_id, max(session_id) AS session_id, min(ts) AS started_at, max(ts) FILTER (name = 'span.end') AS ended_at, count(*) AS n_events FROM ev GROUP BY 1),
  en AS (SELECT trace_id, last(coalesce(error, '') ORDER BY ts, event_id) AS error FROM ev WHERE name = 'span.end' GROUP BY 1)"""


@query("W3", """WITH ev AS (SELECT md5(concat_ws('|', user_id, strftime(ts, '%Y-%m-%d'))) AS trace_id, * FROM events)
SELECT trace_id, event_id AS span_id, CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'purchase' THEN -1
ELSE lag(event_id) OVER (PARTITION BY trace_id ORDER BY ts, event_id) END AS parent_span_id FROM ev""")
def span_parents(spark, sf):
    """Span parents of the event traces; signups are roots."""
    e = trace_events(spark, sf)
    spans = e.select("trace_id", F.col("event_id").alias("span_id"), F.col("ts").alias("start_time"),
                     F.when(F.col("phase") == "purchase", -1).cast("long").alias("parent_span_id"),
                     (F.col("phase") == "signup").alias("is_root"))
    return traces.span_parents(spans).select("trace_id", "span_id", "parent_span_id")


@query("T2 W4 F19", f"""WITH {TRACE_SQL} SELECT trace_id, trace_id AS otel_trace_id, session_id,
CASE WHEN ended_at IS NULL THEN 'running' WHEN en.error <> '' THEN 'failed' ELSE 'success' END AS status, epoch_us(started_at) AS started_us,
((epoch_us(ended_at) - epoch_us(started_at)) / 1000)::DOUBLE::BIGINT AS x, least(n_events, 200) AS n_events, coalesce((SELECT count(*) FROM st WHERE st.trace_id = rec.trace_id), 0) AS n_steps
FROM rec LEFT JOIN en USING (trace_id)""".replace("((epoch_us(ended_at) - epoch_us(started_at)) / 1000)::DOUBLE::BIGINT AS x", "((epoch_us(ended_at) - epoch_us(started_at)) // 1000)::BIGINT AS duration_ms"))
def trace_records(spark, sf):
    """One record per trace with status and sizes of its lists."""
    r = traces.trace_records(trace_events(spark, sf))
    return r.select("trace_id", "otel_trace_id", "session_id", "status", F.unix_micros("started_at").alias("started_us"), "duration_ms",
                    F.size("events").cast("long").alias("n_events"), F.coalesce(F.size("steps"), F.lit(0)).cast("long").alias("n_steps"))


@query("T10 W4", f"""WITH {TRACE_SQL} SELECT trace_id, index, phase, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, payload AS observation, duration_ms, error FROM st""")
def trace_views(spark, sf):
    """Steps view of all trace records."""
    return traces.trace_steps(traces.trace_records(trace_events(spark, sf)))


@query("T10", f"""WITH {TRACE_SQL} SELECT trace_id, 'event' AS kind, (row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) - 1)::INT AS pos, name AS label FROM ev
UNION ALL SELECT trace_id, 'step', (index - 1)::INT, phase FROM st""")
def trace_replay(spark, sf):
    """Replay view of all trace records."""
    return traces.replay(traces.trace_records(trace_events(spark, sf)))


@query("W5 J17 T3", f"""WITH {TRACE_SQL} SELECT session_id, trace_id, rank FROM (SELECT session_id, trace_id, row_number() OVER (PARTITION BY session_id ORDER BY started_at DESC, trace_id) AS rank FROM rec) WHERE rank <= 10""")
def session_traces(spark, sf):
    """Ten newest traces of each session."""
    return traces.session_traces(traces.trace_heads(trace_events(spark, sf)), 10).select("session_id", "trace_id", "rank")


@query("A16 W6", f"""WITH {TRACE_SQL}, n AS (SELECT * FROM rec ORDER BY started_at DESC, trace_id DESC LIMIT 50),
sp AS (SELECT trace_id, event_id, phase, row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS rn FROM ev WHERE trace_id IN (SELECT trace_id FROM n))
SELECT trace_id, string_agg(event_id || ':' || phase, ',' ORDER BY rn) AS spans FROM sp WHERE rn <= 20 GROUP BY 1""")
def request_log(spark, sf):
    """Fifty newest traces with their first spans."""
    e = trace_events(spark, sf)
    rec = e.groupBy("trace_id").agg(F.min("ts").alias("started_at"), F.lit(None).cast("string").alias("error"),
                                    F.sum("duration_ms").alias("duration_ms"))
    spans = position(e, ["trace_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "span_no").select(
        "trace_id", "span_no", F.col("event_id").cast("string").alias("span_id"), F.col("phase").alias("operation"), "duration_ms")
    out = catalog.request_log(rec, spans)
    return out.select("trace_id", F.array_join(F.transform("spans", lambda s: F.concat(s["span_id"], F.lit(":"), s["operation"])), ",").alias("spans"))


@query("F18", """SELECT doc_id, CASE WHEN length(text) > 4000 THEN md5(substr(text, 1, 4000) || '...[truncated]') ELSE md5(text) END AS digest,
CASE WHEN length(source) > 3 THEN substr(source, 1, 3) || '...[truncated]' ELSE source END AS first_item, 2 AS n_keys FROM documents""")
def payload_trim(spark, sf):
    """Document payloads with long strings, lists and maps cut."""
    d = table(spark, sf, "documents")
    payload = F.create_map(F.lit("a"), F.col("text"), F.lit("b"), F.col("lang"), F.lit("c"), F.col("source"))
    items = F.array_repeat(F.col("source"), 60)
    m = tx.trim_payload(payload, max_keys=2)
    return d.select("doc_id", F.md5(m["a"]).alias("digest"), tx.trim_list(items, 3)[0].alias("first_item"), F.size(m).alias("n_keys"))


@query("F18", """WITH d AS (SELECT doc_id, string_split(text, chr(10))[:50] AS parts, lang, source FROM documents),
c AS (SELECT *, list_transform(parts, lambda p: CASE WHEN length(p) > 4000 THEN substr(p, 1, 4000) || '...[truncated]' ELSE p END) AS cut FROM d)
SELECT doc_id, len(cut) AS n_parts, md5(array_to_string(cut, chr(10))) AS parts_digest,
md5(cut[len(cut)]) AS last_digest, source AS origin FROM c""")
def payload_nested(spark, sf):
    """Nested payloads of documents, cut at every depth: a map of structs with lists of strings."""
    d = table(spark, sf, "documents")
    body = F.struct(F.split("text", "\n", -1).alias("parts"), F.struct("lang", "source").alias("from"))
    d = d.select("doc_id", F.create_map(F.lit("body"), body).alias("payload"))
    cut = tx.trim_nested(F.col("payload"), d.schema["payload"].dataType)
    parts = F.col("cut")["body"]["parts"]
    return d.select("doc_id", cut.alias("cut")).select(
        "doc_id", F.size(parts).cast("long").alias("n_parts"), F.md5(F.array_join(parts, "\n")).alias("parts_digest"),
        F.md5(F.element_at(parts, -1)).alias("last_digest"), F.col("cut")["body"]["from"]["source"].alias("origin"))


def detailed_events(spark, sf):
    """Trace events with spans and what their steps called."""
    e = trace_events(spark, sf)
    n = F.col("event_id")
    return e.withColumns({
        "span_id": n, "mode": F.when(n % 3 == 0, "plan").when(n % 3 == 1, ""), "intent": F.when(n % 2 == 0, F.col("phase")),
        "action": F.when(n % 4 == 0, "").when(n % 4 == 1, "search"), "tool": F.when(n % 5 < 3, "calc"),
        "subtask_id": F.concat(F.lit("t"), (n % 7).cast("string")), "status": F.when(n % 6 == 0, "skipped"),
        "action_input": F.create_map(F.lit("q"), F.col("payload"))})


@query("T2", f"""WITH {TRACE_SQL}, o AS (SELECT trace_id, event_id, name, row_number() OVER (PARTITION BY trace_id ORDER BY name <> 'span.start', ts, event_id) AS rn, phase FROM ev)
SELECT trace_id, event_id AS root_span_id, CASE WHEN name = 'span.start' AND event_id % 3 = 0 THEN 'plan' ELSE 'react' END AS mode,
CASE WHEN name = 'span.start' AND event_id % 2 = 0 THEN phase END AS intent FROM o WHERE rn = 1""")
def trace_origins(spark, sf):
    """Root span, mode and intent of all traces."""
    return traces.trace_origins(detailed_events(spark, sf))


@query("T2 W4 F9", f"""WITH {TRACE_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS total FROM st)
SELECT trace_id, index, phase, CASE WHEN event_id % 6 = 0 THEN 'skipped' WHEN coalesce(error, '') <> '' THEN 'error' ELSE 'success' END AS status,
CASE WHEN event_id % 4 = 1 THEN 'search' WHEN event_id % 5 < 3 THEN 'calc' ELSE 't' || event_id % 7 END AS action,
payload AS query, duration_ms, error, event_id AS span_id, payload AS raw FROM n WHERE index > total - 100""")
def traced_steps(spark, sf):
    """Last steps of all traces with action, input, span and raw payload."""
    steps = traces.traced_steps(detailed_events(spark, sf)).drop("ts")
    return steps.withColumn("query", F.col("action_input")["q"]).drop("action_input")


@query("W6", f"""WITH {TRACE_SQL} SELECT trace_id, session_id, epoch_us(started_at) AS started_us FROM rec ORDER BY started_at DESC, trace_id DESC LIMIT 5000""")
def capped_traces(spark, sf):
    """The 5000 newest traces."""
    kept = catalog.cap_traces(traces.trace_heads(trace_events(spark, sf)))
    return kept.select("trace_id", "session_id", F.unix_micros("started_at").alias("started_us"))


# --- cache, labels, catalogue ---------------------------------------------------------

@query("J14 F5 F6 V17", f"""WITH {HASH_COSINE_SQL}, live AS (SELECT item_id FROM benchmark WHERE item_id % 4 <> 0),
r AS (SELECT id AS query_id, query_id AS entry_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, query_id) AS rn FROM hcos WHERE query_id IN (SELECT item_id FROM live))
SELECT r.query_id, entry_id, round(score, 6) AS similarity, 'answer ' || entry_id AS value FROM r WHERE rn = 1 AND score >= 0.9""")
def cache_lookup(spark, sf):
    """Documents looked up in a cache of benchmark texts; a quarter has expired."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text", tx.normalize_text(F.col("text")).alias("vec"))
    b = table(spark, sf, "benchmark")
    entries = b.select(F.col("item_id").alias("entry_id"), F.col("text").alias("query_text"),
                       F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("value"), hash_embedding(F.col("text")).alias("vec"),
                       F.when(F.col("item_id") % 4 == 0, 10).otherwise(1000).alias("expires_at"))
    out = matching.cache_lookup(d, entries, F.lit(500), 0.9)
    return out.select("query_id", "entry_id", F.round("similarity", 6).alias("similarity"), "value")


def intent_sql():
    q = r"lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))"
    has = lambda ws: "(" + " OR ".join(f"contains({q}, '{w}')" for w in ws) + ")"
    rules = []
    for i, (ws, root, sub, conf) in enumerate(tx.INTENT_RULES):
        cond = has(ws) if i else rf"(regexp_matches({q}, '[0-9]+\s*[-+*/%^]\s*[0-9]+') OR {has(ws)})"
        rules.append(f"WHEN {cond} THEN '{root}|{sub}|{conf}'")
    counts = ", ".join("{'h': " + " + ".join(f"contains({q}, '{w}')::INT" for w in ws) + f", 'o': {-i}, 'l': '{r}|{s}'}}"
                       for i, (r, s, ws) in enumerate(tx.INTENT_KEYWORDS))
    best = f"list_aggregate([{counts}], 'max')"
    return f"""CASE {' '.join(rules)} WHEN {best}.h > 0 THEN {best}.l || '|' || round(least(0.95, 0.45 + 0.12 * {best}.h), 4)::DOUBLE
      WHEN contains({q}, '?') OR contains({q}, '？') THEN '问答|知识问答|0.35' ELSE '问答|知识问答|0.25' END"""


INTENT_TEXT_SQL = """SELECT conv_id, turn, CASE conv_id % 9 WHEN 0 THEN '计算 ' || turn || ' + 2.5 ' WHEN 1 THEN '帮我找 ' WHEN 2 THEN 'SQL ' WHEN 3 THEN '文档 '
  WHEN 4 THEN '技能 ' WHEN 5 THEN '谢谢 再见 ' WHEN 6 THEN '上传 PDF 概括 ' WHEN 7 THEN '? ' ELSE '' END || text AS text FROM conversations"""


def intent_texts(spark, sf):
    heads = F.array(F.concat(F.lit("计算 "), F.col("turn").cast("string"), F.lit(" + 2.5 ")), *[F.lit(x) for x in (
        "帮我找 ", "SQL ", "文档 ", "技能 ", "谢谢 再见 ", "上传 PDF 概括 ", "? ", "")])
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.concat(F.element_at(heads, (F.col("conv_id") % 9 + 1).cast("int")), "text").alias("text"))


@query("F25", rf"""WITH c AS ({INTENT_TEXT_SQL}), l AS (SELECT conv_id, turn, {intent_sql()} AS l,
  array_to_string(regexp_extract_all(text, '[-+]?[0-9]*\.[0-9]+|[0-9]+')[1:5], ',') AS numbers FROM c)
SELECT conv_id, turn, split_part(l, '|', 1) AS intent, split_part(l, '|', 2) AS sub_intent, round(split_part(l, '|', 3)::DOUBLE, 4) AS confidence, numbers FROM l""")
def intent_labels(spark, sf):
    """Intent of every message with a rendered opening."""
    out = intent_texts(spark, sf).select("conv_id", "turn", tx.intent(F.col("text")).alias("i"))
    return out.select("conv_id", "turn", "i.intent", "i.sub_intent", F.round("i.confidence", 4).alias("confidence"),
                      F.array_join("i.numbers", ",").alias("numbers"))


@query("F26", rf"""WITH c AS ({INTENT_TEXT_SQL}), l AS (SELECT conv_id, turn, {intent_sql()} AS l, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn / 8 END AS mc FROM c),
s AS (SELECT *, split_part(l, '|', 1) AS ri, split_part(l, '|', 3)::DOUBLE AS rc FROM l)
SELECT conv_id, turn, CASE WHEN rc >= 0.8 OR mc IS NULL OR mc < rc THEN ri ELSE '任务' END AS intent,
CASE WHEN rc >= 0.8 OR mc IS NULL OR mc < rc THEN 'rule' ELSE 'model' END AS chosen,
CASE WHEN rc >= 0.8 OR mc IS NULL OR mc < rc THEN rc ELSE mc END < 0.55 AS needs_clarification FROM s""")
def intent_cascade(spark, sf):
    """Rule labels against model labels; every third message has none."""
    model = F.when(F.col("turn") % 3 != 0, F.struct(F.lit("任务").alias("intent"), F.lit("搜索").alias("sub_intent"),
                                                    (F.col("turn") / 8).alias("confidence")))
    c = intent_texts(spark, sf).withColumn("r", tx.intent(F.col("text"))).withColumn("m", model)
    out = c.select("conv_id", "turn", tx.cascade_intent(F.col("text"), F.col("r"), F.col("m")).alias("x"))
    return out.select("conv_id", "turn", "x.intent", "x.chosen", "x.needs_clarification")


@query("J15", r"""WITH q AS (SELECT conv_id, turn, lower(text || ' nation_' || turn) AS q FROM conversations),
i AS (SELECT n_nationkey AS position, n_name AS name, list_filter(regexp_extract_all(lower(n_name || ' in ' || r_name), '[\p{L}\p{N}_]+'), lambda t: length(t) > 1) AS toks
      FROM nation JOIN region ON r_regionkey = n_regionkey),
s AS (SELECT conv_id, turn, name, position, CASE WHEN contains(q, lower(name)) THEN 3.0 ELSE 0.0 END + len(list_filter(toks, lambda t: contains(q, t))) AS score FROM q, i),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, position) AS rank FROM s)
SELECT conv_id || ':' || turn AS query_id, rank::INT AS rank, name, score::DOUBLE AS score FROM r WHERE rank <= 3""")
def catalog_routing(spark, sf):
    """Three best nations per message by name and description."""
    items = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("position"), F.col("n_name").alias("name"), F.concat_ws(" in ", "n_name", "r_name").alias("description"))
    c = table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.concat("text", F.lit(" nation_"), F.col("turn").cast("string")).alias("text"))
    return matching.route_catalog(c, "query_id", "text", items, 3)


@query("F21", """SELECT conv_id AS conversation_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS block
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3 GROUP BY 1""")
def history_blocks(spark, sf):
    """Printed last three turns of each thread."""
    from quarry.operators.ranking import top_k

    return context.history_block(top_k(messages(spark, sf), ["conversation_id"], [F.col("index").desc()], 3))
