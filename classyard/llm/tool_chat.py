"""Linking tool calls to their results in chats, in DataFrame functions only.

Calls (conv_id, call_id, parent_id, tool, arguments) and results (call_id,
content) are joined by identifier; calls are ordered topologically by the call
they depend on (``level``: length of the chain of parents, found by pointer
doubling, so rounds grow with the logarithm of the longest chain); arguments are
validated against the schemas of their tools; and each linked pair is serialised
as canonical JSON (sorted keys, no blanks).  ``(conv_id, level, call_id)`` sorts
a conversation so that every call follows the one it depends on; no conversation
is ever gathered in one task.

``status`` is the first that applies of: ``unidentified`` (null identifier;
such calls and results are rows of their own and never linked), ``orphan``
(result without call), ``cycle`` (a call that depends on itself in the end; its
level is null), ``unanswered``, ``invalid`` (see ``errors``), ``ok``.  A parent that
is no call counts as absent.  Identifiers hold everywhere, or within one conversation
(``within=True``; rows without conv_id are one conversation then, and parents belong
to the conversation of their call).  Calls of one identifier are one row, the smallest
of them by parent, tool and arguments; of results the smallest content; ``n_calls`` and
``n_results`` count the input rows behind an output row, so none goes unseen.
Arguments that are null or no JSON object are invalid; tools without a schema are, too.
``chat_rows`` adds the messages that are neither call nor result (system, null and
other roles), one row each of status ``message``.  Texts of any length are read whole.
Empty tables give no rows; only the named columns are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classyard.llm.common import split_words, stored

# Tool -> argument -> (type, required, least, most); the bounds
# are of a number or of a string's length.
SCHEMAS = {
    "search": {"limit": ("integer", True, 1, 10), "query": ("string", True, 1, 400)},
    "translate": {"target": ("string", True, 2, 2), "text": ("string", True, 1, 600)},
    "summarise": {"ratio": ("number", True, 0, 1), "text": ("string", True, 40, None)},
}

_KINDS = {"integer": r"^BIGINT$", "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$", "string": r"^STRING$", "boolean": r"^BOOLEAN$"}


def _argument_errors(value: Column, tool: str, schema: dict) -> list[Column]:
    out = [F.when(F.size(F.array_except(F.json_object_keys("arguments"), F.array(*[F.lit(a) for a in schema]))) > 0, "unknown argument")]
    for name, (kind, required, low, high) in schema.items():
        here = F.try_variant_get(value, f"$.{name}", "string")
        shape = F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")), F.lit("VOID"))
        size = F.length(here).cast("double") if kind == "string" else here.try_cast("double")
        wrong = F.when(shape == "VOID", F.lit(f"{name} is missing") if required else F.lit(None))
        wrong = wrong.when(~shape.rlike(_KINDS[kind]), f"{name} is no {kind}")
        for bound, bad in ((low, size < low if low is not None else None), (high, size > high if high is not None else None)):
            if bound is not None:
                wrong = wrong.when(bad, f"{name} is out of bounds")
        out.append(wrong)
    return out


def errors_of(tool: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """What is wrong with the arguments, '; '-separated; '' if nothing."""
    value = F.try_parse_json(arguments)
    found = F.when(value.isNull() | ~F.coalesce(F.schema_of_variant(value), F.lit("")).startswith("OBJECT"), "arguments are no object")
    for name, schema in sorted(schemas.items()):
        found = found.when(tool == name, F.concat_ws("; ", *_argument_errors(value, name, schema)))
    return found.otherwise("unknown tool")


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of calls (call_id unique, parent_id): the number of
    calls above each one; null if it hangs on a cycle."""
    ids = calls.select(F.col("call_id").alias("parent_id"))
    # a parent that is no call counts as absent
    open_ = stored(calls.select("call_id", "parent_id").join(ids, "parent_id", "left_semi")
                   .select("call_id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("steps")), "chat-open")
    done = calls.select("call_id").join(open_.select("call_id"), "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level"))
    left = open_.count()
    while left:
        # up: the call `steps` above; it is done, or it knows its own one above
        above = open_.select(F.col("call_id").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"))
        known = done.select(F.col("call_id").alias("up"), F.col("level").alias("base"))
        step = stored(open_.join(known, "up", "left").join(above, "up", "left"), "chat-step")
        done = stored(done.unionByName(step.where("base is not null").select("call_id", (F.col("steps") + F.col("base")).alias("level"))), "chat-done")
        open_ = stored(step.where("base is null").select("call_id", F.col("far").alias("up"), (F.col("steps") + F.col("more")).alias("steps")), "chat-open")
        now = open_.count()
        if now == left:        # only cycles are left, and what hangs on them
            break
        left = now
    return done.unionByName(open_.select("call_id", F.lit(None).cast("long").alias("level")))


def linked(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS, within: bool = False) -> DataFrame:
    """conv_id, call_id, parent_id, tool, level, status, errors, json, n_calls, n_results.
    With ``within`` results have a conv_id, too, and identifiers are those of a conversation."""
    one = F.lit(1).cast("long")
    calls = calls.select(F.col("conv_id").cast("long").alias("conv_id"),
                         *[F.col(c).cast("string").alias(c) for c in ("call_id", "parent_id", "tool", "arguments")])
    results = results.select((F.col("conv_id") if within else F.lit(None)).cast("long").alias("answer_conv"),
                             *[F.col(c).cast("string").alias(c) for c in ("call_id", "content")])

    def key(conv: str, name: str) -> Column:
        return F.concat(F.coalesce(F.col(conv).cast("string"), F.lit("")), F.lit(":"), F.col(name)) if within else F.col(name)
    # one row per identifier: copies are put together before the shuffle
    first = F.min(F.struct("conv_id", "parent_id", "tool", "arguments")).alias("c")
    named = stored(calls.where("call_id is not null").groupBy(key("conv_id", "call_id").alias("k"), "call_id")
                   .agg(first, F.count(F.lit(1)).alias("n_calls")).select("k", "call_id", "c.*", "n_calls"), "chat-calls")
    answers = (results.where("call_id is not null").groupBy(key("answer_conv", "call_id").alias("k"), F.col("call_id").alias("answer_id"))
               .agg(F.min("answer_conv").alias("answer_conv"), F.min("content").alias("content"), F.count(F.lit(1)).alias("n_results")))
    level = levels(named.select(F.col("k").alias("call_id"), key("conv_id", "parent_id").alias("parent_id"))).withColumnRenamed("call_id", "k")
    both = (named.withColumn("called", F.lit(True)).join(level, "k").join(answers, "k", "full_outer")
            .withColumn("call_id", F.coalesce("call_id", "answer_id")))
    rows = both.unionByName(calls.where("call_id is null").withColumns({"called": F.lit(True), "n_calls": one}), allowMissingColumns=True) \
        .unionByName(results.where("call_id is null").withColumn("n_results", one), allowMissingColumns=True)
    rows = rows.withColumns({
        "errors": F.when(F.col("called"), errors_of(F.col("tool"), F.col("arguments"), schemas)).otherwise(""),
        "conv_id": F.when(F.col("called"), F.col("conv_id")).otherwise(F.col("answer_conv")),
        "n_calls": F.coalesce("n_calls", one * 0), "n_results": F.coalesce("n_results", one * 0)})
    status = (F.when(F.col("call_id").isNull(), "unidentified").when(F.col("called").isNull(), "orphan")
              .when(F.col("level").isNull(), "cycle").when(F.col("n_results") == 0, "unanswered")
              .when(F.col("errors") != "", "invalid").otherwise("ok"))
    value = F.try_parse_json("arguments")
    canonical = F.when(value.isNull(), F.lit("null")).otherwise(F.to_json(value))
    body = [("arguments", canonical), ("call_id", _quoted(F.col("call_id"))), ("level", F.coalesce(F.col("level").cast("string"), F.lit("null"))),
            ("parent_id", _quoted(F.col("parent_id"))), ("result", _quoted(F.col("content"))), ("tool", _quoted(F.col("tool")))]
    return rows.withColumn("status", status).withColumn("json", _object(body)) \
        .select("conv_id", "call_id", "parent_id", "tool", "level", "status", "errors", "json", "n_calls", "n_results")


def _object(body: list[tuple[str, Column]]) -> Column:
    """A JSON object of serialised values, whose names come sorted."""
    parts = [x for k, (name, v) in enumerate(body) for x in (F.lit(("," if k else "{") + f'"{name}":'), v)]
    return F.concat(*parts, F.lit("}"))


def _quoted(text: Column) -> Column:
    """A JSON string, or null."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNull(), F.lit("null")).otherwise(whole.substr(F.lit(6), F.length(whole) - 6))


def from_conversations(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain chats: each user message calls a tool with
    its text, and depends on the user message two turns before; the assistant
    message of the next turn is its result."""
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def name(turn: Column) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    n = F.size(split_words(F.col("text")))
    quoted = _quoted(F.col("text"))
    tool = F.when(n <= 12, "search").when(F.col("text").rlike(r"[^\x00-\x7F]"), "translate").otherwise("summarise")
    arguments = (F.when(n <= 12, F.concat(F.lit('{ "query" : '), quoted, F.lit(', "limit" : '), n.cast("string"), F.lit(" }")))
                 .when(F.col("text").rlike(r"[^\x00-\x7F]"), F.concat(F.lit('{"text":  '), quoted, F.lit(' , "target":"en"}')))
                 .otherwise(F.concat(F.lit('{ "text":'), quoted, F.lit(', "ratio":0.25 }'))))
    calls = m.where("role = 'user'").select("conv_id", name(F.col("turn")).alias("call_id"), name(F.col("turn") - 2).alias("parent_id"),
                                            tool.alias("tool"), arguments.alias("arguments"))
    return calls, m.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))


def chat_links(messages: DataFrame) -> DataFrame:
    return linked(*from_conversations(messages), within=True)


def chat_rows(messages: DataFrame) -> DataFrame:
    """``chat_links`` and one row for every message that is neither call nor
    result: ``n_calls`` + ``n_results`` + rows of status ``message`` are all rows."""
    turn = F.coalesce(F.col("turn").cast("long").cast("string"), F.lit("null"))
    other = messages.where("coalesce(role, '') NOT IN ('user', 'assistant')").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.lit("message").alias("status"), F.lit("").alias("errors"),
        _object([("content", _quoted(F.coalesce(F.col("text").cast("string"), F.lit("")))), ("role", _quoted(F.col("role").cast("string"))), ("turn", turn)]).alias("json"),
        F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_results"))
    return chat_links(messages).unionByName(other, allowMissingColumns=True)


ORACLE_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), q AS (
  SELECT conv_id, turn, text, to_json(text)::VARCHAR AS quoted, regexp_matches(text, '[^\x00-\x7F]') AS wide,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n
  FROM m WHERE role = 'user'
), p AS (
  SELECT *, CASE WHEN n <= 12 THEN 'search' WHEN wide THEN 'translate' ELSE 'summarise' END AS tool,
    CASE WHEN n <= 12 THEN '{ "query" : ' || quoted || ', "limit" : ' || n || ' }'
         WHEN wide THEN '{"text":  ' || quoted || ' , "target":"en"}' ELSE '{ "text":' || quoted || ', "ratio":0.25 }' END AS raw
  FROM q
), u AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS n_calls FROM p WHERE conv_id IS NOT NULL AND turn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY tool, raw) = 1
), a AS (
  SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n_results FROM m
  WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
), island AS (
  SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS g FROM u
), lev AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, g ORDER BY turn) - 1 AS level FROM island
), linked AS (
  SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.conv_id, a.conv_id) || ':' || coalesce(c.turn, a.turn) AS call_id,
    c.conv_id || ':' || (c.turn - 2) AS parent_id, c.conv_id IS NOT NULL AS called, a.conv_id IS NOT NULL AS answered,
    n, wide, quoted, text, tool, level, content, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results
  FROM lev AS c FULL OUTER JOIN a ON c.conv_id = a.conv_id AND c.turn = a.turn
  UNION ALL
  SELECT conv_id, NULL, NULL, true, false, n, wide, quoted, text, tool, NULL, NULL, 1, 0 FROM p WHERE conv_id IS NULL OR turn IS NULL
  UNION ALL
  SELECT conv_id, NULL, NULL, false, true, NULL, NULL, NULL, NULL, NULL, NULL, text, 0, 1
  FROM m WHERE role = 'assistant' AND (conv_id IS NULL OR turn IS NULL)
), e AS (
  SELECT *, CASE WHEN NOT called THEN NULL WHEN n <= 12 THEN '{"limit":' || n || ',"query":' || quoted || '}'
         WHEN wide THEN '{"target":"en","text":' || quoted || '}' ELSE '{"ratio":0.25,"text":' || quoted || '}' END AS args,
    CASE WHEN NOT called THEN ''
         WHEN n <= 12 THEN concat_ws('; ', CASE WHEN n < 1 OR n > 10 THEN 'limit is out of bounds' END,
                                     CASE WHEN length(text) < 1 OR length(text) > 400 THEN 'query is out of bounds' END)
         WHEN wide THEN CASE WHEN length(text) > 600 THEN 'text is out of bounds' ELSE '' END
         ELSE CASE WHEN length(text) < 40 THEN 'text is out of bounds' ELSE '' END END AS errors
  FROM linked
)
SELECT conv_id, call_id, parent_id, tool, level,
  CASE WHEN call_id IS NULL THEN 'unidentified' WHEN NOT called THEN 'orphan' WHEN NOT answered THEN 'unanswered'
       WHEN errors <> '' THEN 'invalid' ELSE 'ok' END AS status, errors,
  '{"arguments":' || coalesce(args, 'null') || ',"call_id":' || coalesce('"' || call_id || '"', 'null')
  || ',"level":' || coalesce(level::VARCHAR, 'null') || ',"parent_id":' || coalesce('"' || parent_id || '"', 'null')
  || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"tool":' || coalesce('"' || tool || '"', 'null') || '}' AS json,
  n_calls::BIGINT AS n_calls, n_results::BIGINT AS n_results
FROM e
UNION ALL
SELECT conv_id, NULL, NULL, NULL, NULL, 'message', '',
  '{"content":' || to_json(text)::VARCHAR || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"turn":' || coalesce(turn::VARCHAR, 'null') || '}', 0, 0
FROM m WHERE coalesce(role, '') NOT IN ('user', 'assistant')
"""
