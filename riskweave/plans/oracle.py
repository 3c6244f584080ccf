"""DuckDB statements shared by the queries' oracles."""

from __future__ import annotations

_MESSAGES = """messages AS (
 SELECT d.doc_id, concat(d.source, '.csv') AS _file, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS _row, d.text AS content,
  CASE WHEN l.doc_id IS NULL THEN '未校验' WHEN l.toxic = 1 THEN '虚假' WHEN l.quality = 1 THEN '真实' ELSE '中立' END AS nature,
  CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE printf('%.2f', ((d.doc_id * 7919) % 10001) / 100.0) END AS fake_probability,
  d.source, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id), '%Y-%m-%d %H:%M:%S') AS publish_time, '' AS process_time
 FROM documents d LEFT JOIN labels l USING (doc_id)),
signed AS (SELECT *, substring(sha1(concat_ws(chr(31), content, nature, fake_probability, source, publish_time, process_time)), 1, 16) AS _signature FROM messages)"""
_TOKENS = "tokens AS (SELECT doc_id, concat(source, '.csv') AS _file, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS tokens FROM documents)"


def messages(select: str) -> str:
    return f"WITH {_MESSAGES} {select}"


def tree(select: str) -> str:
    """Levels of digests: over 64 rows, over 64 nodes three times, and over what is left of a file."""
    level = lambda k, up: f"l{k} AS (SELECT _file, {up} AS _range, sum(n)::BIGINT AS n, sha1(string_agg(digest, chr(31) ORDER BY _range)) AS digest FROM l{k - 1} GROUP BY _file, {up})"
    levels = ", ".join(level(k, "_range // 64" if k < 4 else "0::BIGINT") for k in range(1, 5))
    return f"""WITH {_MESSAGES},
l0 AS (SELECT _file, _row // 64 AS _range, count(*) AS n, sha1(string_agg(sha1(content), chr(31) ORDER BY _row)) AS digest FROM messages GROUP BY _file, _row // 64), {levels},
tree AS ({" UNION ALL ".join(f"SELECT {k} AS level, * FROM l{k}" for k in range(5))})
{select}"""


def tokens(select: str) -> str:
    return f"WITH {_TOKENS} {select}"


def bm25(query: str, select: str) -> str:
    terms = ", ".join(sorted({f"'{t}'" for t in query.lower().split()}))
    return f"""WITH {_MESSAGES}, {_TOKENS},
meta AS (SELECT count(*) AS n, round(sum(len(tokens)) / count(*), 6) AS avgdl FROM tokens),
tf AS (SELECT _file, doc_id, term, dl, count(*) AS tf FROM (SELECT _file, doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM tokens) WHERE term IN ({terms}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scores AS (SELECT _file, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term), meta GROUP BY _file, doc_id)
{select}"""


def over(table: str, statement: str) -> str:
    """The statement over another table in place of one of the given ones."""
    return statement.replace("WITH ", f"WITH {table}, ", 1)


def bm25_many(queries: tuple[str, ...], limit: int) -> str:
    """The best messages of each query."""
    asked = " UNION ALL ".join(f"SELECT '{q}' AS query, '{t}' AS term" for q in queries for t in sorted(set(q.split())))
    return f"""WITH {_MESSAGES}, {_TOKENS}, asked AS ({asked}),
meta AS (SELECT count(*) AS n, round(sum(len(tokens)) / count(*), 6) AS avgdl FROM tokens),
tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM tokens) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scores AS (SELECT query, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN tf USING (term) JOIN df USING (term), meta GROUP BY query, doc_id)
SELECT query, _file, _row, score FROM scores JOIN messages USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, _file, _row) <= {limit}"""


def hot(more: str, limit: int, select: str) -> str:
    return f"""WITH {_TOKENS}, df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM tokens) GROUP BY term),
hot AS (SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, round(df * ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS score FROM df, (SELECT count(*) AS n FROM documents)
 WHERE length(term) >= 2 AND df >= 2 AND df < 0.9 * n {more} ORDER BY score DESC, term LIMIT {limit})
{select}"""


def samples(select: str) -> str:
    return f"""WITH {_MESSAGES}, samples AS (SELECT fake_probability::DOUBLE AS prob, nature FROM messages WHERE fake_probability <> '' AND nature <> '未校验'),
counts AS (SELECT t::DOUBLE AS threshold, count(*) FILTER (nature = '虚假' AND prob >= t) AS tp, count(*) FILTER (nature = '真实' AND prob >= t) AS fp, count(*) FILTER (nature = '真实' AND prob < t) AS tn, count(*) FILTER (nature = '虚假' AND prob < t) AS fn
 FROM samples, (SELECT unnest([50, 30, 40, 60, 70]) AS t) GROUP BY t),
parts AS (SELECT *, tp + fp + tn + fn AS total, coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM counts),
metrics AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM parts)
{select}"""


def vote(select: str) -> str:
    return f"""WITH raw AS (SELECT doc_id, k AS ordinal, ['alpha', 'beta', 'gamma'][k + 1] AS model_id, doc_id % 7 <> k AS available, ((doc_id * [31, 57, 83][k + 1]) % 11000) / 100.0 AS score FROM documents, (SELECT unnest([0, 1, 2]) AS k)),
marked AS (SELECT *, CASE WHEN NOT available THEN 'unavailable' WHEN score <= 100 THEN 'ok' ELSE 'error' END AS status, CASE WHEN score < 40 THEN 'low' WHEN score < 70 THEN 'medium' ELSE 'high' END AS band FROM raw),
members AS (SELECT doc_id, ordinal, model_id, status, CASE WHEN status = 'ok' THEN score END AS score, CASE WHEN status = 'ok' THEN band END AS level,
 CASE WHEN status = 'unavailable' THEN '模型不可用' WHEN status = 'error' THEN '检测失败' WHEN band = 'low' THEN '低风险' WHEN band = 'medium' THEN '中风险' ELSE '高风险' END AS label,
 CASE WHEN status = 'ok' THEN concat('reason ', doc_id) ELSE '' END AS reason, CASE WHEN status = 'unavailable' THEN '该模型当前不可用，请检查本地服务和模型权重' WHEN status = 'error' THEN '模型返回了无效的风险分数' END AS error FROM marked),
counts AS (SELECT doc_id, count(*) FILTER (level = 'low') AS low, count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'high') AS high, count(score) AS success_count, count(*) AS selected_count, avg(score) AS mean FROM members GROUP BY doc_id),
methods AS (SELECT *, greatest(low, medium, high) AS agreement_count, 2::BIGINT AS majority_required, CASE WHEN greatest(low, medium, high) >= 2 THEN 'majority' WHEN success_count > 0 THEN 'mean_fallback' ELSE 'unavailable' END AS decision_method FROM counts),
levels AS (SELECT *, 'vote' AS mode, success_count < selected_count AS has_failures, CASE WHEN decision_method = 'mean_fallback' THEN round(mean, 6) END AS mean_score,
 CASE decision_method WHEN 'unavailable' THEN 'uncertain' WHEN 'majority' THEN CASE WHEN low >= medium AND low >= high THEN 'low' WHEN medium >= high THEN 'medium' ELSE 'high' END ELSE CASE WHEN mean < 40 THEN 'low' WHEN mean < 70 THEN 'medium' ELSE 'high' END END AS level FROM methods),
decided AS (SELECT *, CASE level WHEN 'low' THEN '低风险' WHEN 'medium' THEN '中风险' WHEN 'high' THEN '高风险' ELSE '无法判断' END AS label FROM levels),
worded AS (SELECT *, CASE WHEN decision_method <> 'mean_fallback' THEN '' WHEN success_count < 2 THEN concat('有效票不足（', success_count, '/3），未达到 2 票的多数门槛') ELSE '票数分歧，未形成多数风险等级' END AS fallback_reason,
 concat(CASE decision_method WHEN 'unavailable' THEN '本次检测没有获得有效风险分数，无法判断。' WHEN 'majority' THEN concat('多数投票结果为', label, '。') ELSE concat(CASE WHEN success_count < 2 THEN concat('有效票不足（', success_count, '/3），未达到 2 票的多数门槛') ELSE '票数分歧，未形成多数风险等级' END, '；已降级采用 ', success_count, ' 个有效模型风险分的算术平均值，结果为', label, '。') END, '语言风险不代表事实真假，模型一致也不等于事实已被核实。') AS warning FROM decided)
{select}"""


def replies(select: str) -> str:
    return f"""WITH bodies AS (SELECT doc_id, concat('{{"risk_score": ', ((doc_id * 31) % 11000) / 100.0, ', "reason": "  because ', doc_id, '"}}') AS body FROM documents),
replies AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN body WHEN 1 THEN concat('```json', chr(10), body, chr(10), '```') WHEN 2 THEN concat('<think>if {{x}}', chr(10), 'then</think>', body) WHEN 3 THEN '{{"risk_score": "12", "reason": "text score"}}'
 WHEN 4 THEN '{{"risk_score": 12, "reason": "x", "more": 1}}' WHEN 5 THEN '{{"risk_score": true, "reason": "x"}}' WHEN 6 THEN 'no json at all' ELSE '{{"risk_score": 55, "reason": "   "}}' END AS reply FROM bodies),
cleaned AS (SELECT doc_id, regexp_replace(reply, '<think(?:ing)?>.*?</think(?:ing)?>', '', 'gs') AS cleaned FROM replies),
objects AS (SELECT doc_id, coalesce(nullif(regexp_extract(cleaned, '\\{{.*\\}}', 0, 's'), ''), cleaned) AS object FROM cleaned),
parsed AS (SELECT doc_id, CASE WHEN json_valid(object) THEN object::JSON END AS j FROM objects),
fields AS (SELECT doc_id, list_sort(json_keys(j)) = ['reason', 'risk_score'] AS exact, json_type(j, '$.risk_score') AS kind, json_type(j, '$.reason') AS reason_kind, try_cast(j ->> '$.risk_score' AS DOUBLE) AS score, trim(j ->> '$.reason') AS reason FROM parsed),
checked AS (SELECT *, coalesce(exact AND kind IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND reason_kind = 'VARCHAR' AND reason <> '' AND score BETWEEN 0 AND 100, false) AS ok FROM fields)
{select}"""


def batch(pending: str, select: str) -> str:
    return f"""WITH {_MESSAGES}, raw AS (SELECT *, ((doc_id * 57) % 11000) / 100.0 AS score FROM messages),
scored AS (SELECT _file, _row, CASE WHEN ({pending}) AND score <= 100 THEN printf('%.2f', score) ELSE fake_probability END AS fake_probability, CASE WHEN NOT ({pending}) THEN 'skipped' WHEN score <= 100 THEN 'done' ELSE 'failed' END AS outcome FROM raw)
{select}"""


def verify(select: str) -> str:
    return f"""WITH {_MESSAGES}, unverified AS (SELECT *, concat(_file, ':', _signature) AS key FROM signed WHERE nature = '未校验'),
skips AS (SELECT key FROM unverified WHERE doc_id % 3 = 0 UNION ALL SELECT concat(_file, ':gone') FROM messages WHERE doc_id % 3 = 0),
queue AS (SELECT * FROM unverified WHERE key NOT IN (SELECT key FROM skips))
{select}"""


def edits(select: str) -> str:
    return f"""WITH {_MESSAGES}, edits AS (SELECT _file, CASE WHEN doc_id % 50 = 43 THEN _row + 1000000000 ELSE _row END AS _row, CASE WHEN doc_id % 20 = 3 THEN _signature WHEN doc_id % 30 = 13 THEN '' ELSE 'stale' END AS signature FROM signed WHERE doc_id % 10 = 3),
joined AS (SELECT m.*, coalesce(e.signature = '' OR e.signature = m._signature, false) AS applies FROM signed m LEFT JOIN edits e USING (_file, _row))
{select}"""


def sessions(now: str, select: str) -> str:
    return f"""WITH sessions AS (SELECT event_id::VARCHAR AS session_id, user_id::VARCHAR AS username, CASE WHEN event_id % 11 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created_at FROM events),
active AS (SELECT * FROM sessions WHERE coalesce(TIMESTAMP '{now}' < try_strptime(created_at, '%Y-%m-%d %H:%M:%S') + INTERVAL 3 DAY, false))
{select}"""


def training(select: str) -> str:
    return f"""WITH {_MESSAGES}, data AS (SELECT content, nature, (nature = '虚假')::INT AS label FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY _file, _row) AS k FROM messages WHERE nature IN ('虚假', '真实')) WHERE k = 1)
{select}"""
