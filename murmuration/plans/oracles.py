r"""SQL that computes the registered queries independently, over the same given tables.

Written for an engine whose regular expressions know neither look-around nor Unicode word
boundaries, so both are spelled out as character classes.
"""

from __future__ import annotations

from murmuration.operators.embed import HASHED_DIMENSIONS
from murmuration.plans.catalog import TOPICS, VECTOR_SIMILARITY

_SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORD = r"\p{L}\p{N}_"
_START = 1704067200000000
_DAY = 86400000000


def _collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{_SPACE}]+', ' ', 'g'), ' ')"


def _norm(text: str) -> str:
    links = f"regexp_replace(lower({text}), 'https?://[^{_SPACE}]+', ' URL ', 'g')"
    users = rf"regexp_replace({links}, '(^|[^{_WORD}])u/[{_WORD}]+', '\1 USER ', 'g')"
    return _collapse(users)


def _hit(text: str, words) -> str:
    return f"regexp_matches(lower({text}), '(^|[^{_WORD}])(?:{'|'.join(words)})($|[^{_WORD}])')"


_ACTIVITY = f"""activity AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
    CASE WHEN user_id % 17 = 0 THEN '[deleted]' ELSE 'u' || CAST(user_id AS VARCHAR) END AS author,
    {_START} + (user_id % 30) * {_DAY} + (epoch_us(ts) - {_START}) // 10 AS us,
    CASE WHEN event_id % 20 = 0 THEN 'post' ELSE 'comment' END AS kind,
    event_type AS subreddit, CAST(round(value * 100) AS BIGINT) AS score,
    CASE WHEN event_id % 20 = 0 THEN NULL WHEN event_id % 20 = 7 THEN 't3_big'
         ELSE 't3_' || CAST(event_id - event_id % 20 AS VARCHAR) END AS link_id,
    CASE WHEN event_id % 20 = 0 THEN NULL
         WHEN event_id % 20 = 1 THEN 't3_' || CAST(event_id - event_id % 20 AS VARCHAR)
         ELSE 't1_' || CAST(event_id - 1 - event_id % 3 AS VARCHAR) END AS parent_id,
    event_id % (SELECT count(*) FROM documents) AS doc_id
  FROM events),
valid AS (SELECT * FROM activity WHERE author <> '[deleted]')"""

_TEXTED = f"""{_ACTIVITY},
texted AS (SELECT a.*, d.text FROM activity a LEFT JOIN documents d USING (doc_id))"""

_RAW = f"""{_TEXTED},
raw AS (
  SELECT id, CASE WHEN author <> '[deleted]' THEN author END AS author,
    CASE WHEN id LIKE '%77' THEN 'not-a-time' ELSE CAST(us // 1000000 AS VARCHAR) END AS created_utc,
    CASE WHEN id LIKE '%5' THEN '' ELSE subreddit END AS subreddit,
    score, kind, link_id, parent_id, 'Post   ' || id AS title, text
  FROM texted),
normal AS (
  SELECT id, kind, coalesce(author, '[deleted]') AS author,
    CASE WHEN created_utc <> 'not-a-time' THEN created_utc || '000000' END AS created_dt,
    subreddit, link_id, parent_id, score,
    {_collapse("CASE WHEN kind = 'post' THEN title || chr(10) || text ELSE text END")} AS text
  FROM raw)"""

_RATES = ", ".join(
    f"avg(CASE WHEN {_hit('text', w)} THEN 1.0 ELSE 0.0 END) AS topic_{t}_rate" for t, w in TOPICS.items()
)
_RATE_NAMES = [f"topic_{t}_rate" for t in TOPICS]
_RATES_CTE = f"""{_TEXTED},
rates AS (SELECT author, {_RATES} FROM (
  SELECT author, {_collapse('text')} AS text FROM texted WHERE author <> '[deleted]') GROUP BY author)"""

_FEATURE_CTES = f"""
base AS (
  SELECT author, count(id) AS activity_count,
    count(*) FILTER (WHERE kind = 'post') AS post_count, count(*) FILTER (WHERE kind = 'comment') AS comment_count,
    count(DISTINCT subreddit) AS subreddit_count, count(DISTINCT link_id) AS thread_count,
    avg(score) AS mean_score, min(us) AS author_first_seen, max(us) AS author_last_seen
  FROM valid GROUP BY author),
shares AS (
  SELECT author, max(n) / sum(n) AS max_subreddit_share
  FROM (SELECT author, subreddit, count(*) AS n FROM valid GROUP BY author, subreddit) GROUP BY author),
gaps AS (
  SELECT author, median(gap) / 6e7 AS median_interarrival_min
  FROM (SELECT author, us - lag(us) OVER (PARTITION BY author ORDER BY us) AS gap FROM valid)
  WHERE gap IS NOT NULL GROUP BY author),
feat AS (
  SELECT b.*, (author_last_seen - author_first_seen) / 86400e6 AS observed_span_days,
    activity_count / greatest((author_last_seen - author_first_seen) / 86400e6, 1.0 / 24) AS activity_per_observed_day,
    (SELECT max(us) FROM valid) - author_first_seen <= 7 * {_DAY} AS new_account_7d,
    (SELECT max(us) FROM valid) - author_first_seen <= 30 * {_DAY} AS new_account_30d,
    max_subreddit_share, median_interarrival_min
  FROM base b LEFT JOIN shares USING (author) LEFT JOIN gaps USING (author)),
scored AS (
  SELECT *, 0.30 * new7 + 0.20 * new30 + 0.20 * burst_signal + 0.15 * concentration_signal
    + 0.15 * volume_signal AS coordination_score
  FROM (SELECT *, CAST(new_account_7d AS BIGINT) AS new7, CAST(new_account_30d AS BIGINT) AS new30,
      1 / (1 + coalesce(median_interarrival_min, 999) / 10) AS burst_signal,
      coalesce(max_subreddit_share, 0) AS concentration_signal,
      ln(1 + activity_count) / ln(1 + greatest((SELECT max(activity_count) FROM feat), 2)) AS volume_signal
    FROM feat))"""
_FEATURES = f"{_ACTIVITY},{_FEATURE_CTES}"

_FEATURE_COLUMNS = """author, activity_count, post_count, comment_count, subreddit_count, thread_count,
  round(mean_score, 6) AS mean_score, author_first_seen, author_last_seen,
  round(observed_span_days, 6) AS observed_span_days,
  round(activity_per_observed_day, 6) AS activity_per_observed_day, new_account_7d, new_account_30d,
  round(max_subreddit_share, 6) AS max_subreddit_share,
  round(median_interarrival_min, 6) AS median_interarrival_min"""
_SIGNAL_COLUMNS = """new7, new30, round(burst_signal, 6) AS burst_signal,
  round(concentration_signal, 6) AS concentration_signal, round(volume_signal, 6) AS volume_signal,
  round(coordination_score, 6) AS coordination_score"""
_TOP = "top AS (SELECT * FROM scored ORDER BY coordination_score DESC, author LIMIT 100)"

_REPLIES = f"""{_ACTIVITY},
replies AS (
  SELECT c.author, p.author AS parent_author, count(*) AS weight
  FROM valid c JOIN (SELECT id, max(author) AS author FROM valid GROUP BY id) p
    ON regexp_replace(c.parent_id, '^t1_', '') = p.id
  WHERE c.kind = 'comment' AND c.author <> p.author GROUP BY c.author, p.author),
network AS (
  SELECT author AS source, parent_author AS target, CAST(sum(weight) AS DOUBLE) AS weight
  FROM replies WHERE author <> parent_author GROUP BY author, parent_author),
heavy AS (SELECT * FROM network WHERE weight >= 2),
ends AS (
  SELECT source AS account, target AS other, weight, 1 AS outgoing FROM heavy
  UNION ALL SELECT target, source, weight, 0 FROM heavy),
degree AS (SELECT account, count(*) AS degree, sum(weight) AS weighted_degree FROM ends GROUP BY account),
top50 AS (SELECT account, degree FROM degree ORDER BY degree DESC, account LIMIT 50),
top80 AS (SELECT account FROM degree ORDER BY degree DESC, account LIMIT 80),
selected AS (
  SELECT * FROM heavy WHERE source IN (SELECT account FROM top80) AND target IN (SELECT account FROM top80)),
shown AS (
  SELECT account, count(*) AS degree FROM (
    SELECT source AS account FROM selected UNION ALL SELECT target FROM selected) GROUP BY account)"""

_THREADS = f"""{_ACTIVITY},
members AS (SELECT DISTINCT link_id, author FROM valid WHERE link_id IS NOT NULL),
threads AS (SELECT link_id FROM members GROUP BY link_id HAVING count(*) BETWEEN 2 AND 80),
shared AS (
  SELECT a.author AS source, b.author AS target, count(*) AS weight
  FROM members a JOIN members b ON a.link_id = b.link_id AND a.author < b.author
  WHERE a.link_id IN (SELECT link_id FROM threads) GROUP BY a.author, b.author)"""

_LANDED = f"""{_ACTIVITY},
landed AS (
  SELECT CASE WHEN id NOT LIKE '%3' THEN id END AS id, author, subreddit, kind,
    CAST(us // 1000000 AS VARCHAR) AS created_utc,
    CAST(id AS BIGINT) // 100 + copy * 7 AS page, CAST(id AS BIGINT) % 100 + copy * 100 AS pos
  FROM (SELECT *, unnest([0, 1]) AS copy FROM activity))"""

_DOCS = f"""docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, source AS author, {_START} + doc_id * 60000000 AS us,
    lang AS subreddit, coalesce(text, '') AS text FROM documents),
eligible AS (
  SELECT *, {_norm('text')} AS norm_text FROM docs WHERE author <> '[deleted]' AND length(text) >= 30)"""

_GRAMS = f"""{_DOCS},
texts AS (SELECT id, lower(norm_text) AS t FROM eligible),
occurrences AS (
  SELECT id, unnest(
    list_concat(list_concat(
      list_transform(range(1, length(t) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]),
      list_transform(range(1, length(t) - 2), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3])),
      list_transform(range(1, length(t) - 3), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3] || c[i + 4]))
  ) AS gram
  FROM (SELECT id, t, string_split(t, '') AS c FROM texts)),
counts AS MATERIALIZED (SELECT id, gram, count(*) AS tf FROM occurrences GROUP BY id, gram),
vocab AS MATERIALIZED (
  SELECT gram, df, cf, ln((1.0 + (SELECT count(*) FROM texts)) / (1.0 + df)) + 1.0 AS idf
  FROM (SELECT gram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM counts GROUP BY gram HAVING count(*) >= 2)
  ORDER BY cf DESC, gram LIMIT 100000),
weights AS MATERIALIZED (
  SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w
  FROM (SELECT id, gram, tf * idf AS w FROM counts JOIN vocab USING (gram)))"""

_NEAR = f"""{_GRAMS},
alike AS MATERIALIZED (
  SELECT a.id AS id_a, b.id AS id_b, least(round(sum(a.w * b.w), 9), 1.0) AS similarity
  FROM weights a JOIN weights b ON a.gram = b.gram AND a.id < b.id
  GROUP BY a.id, b.id HAVING round(sum(a.w * b.w), 9) >= 0.88),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY similarity DESC, id_b) + 1 AS rank
  FROM (SELECT * FROM alike UNION ALL SELECT id_b, id_a, similarity FROM alike)),
pairs AS (
  SELECT r.id_a, r.id_b, a.author AS author_a, b.author AS author_b, r.similarity,
    a.us AS created_a, b.us AS created_b, a.subreddit AS subreddit_a, b.subreddit AS subreddit_b,
    md5(a.text) AS text_a, md5(b.text) AS text_b
  FROM ranked r JOIN eligible a ON a.id = r.id_a JOIN eligible b ON b.id = r.id_b
  WHERE r.rank <= 10 AND a.author <> b.author)"""

_VECTORS = f"""unit AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
    nullif(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 0) AS norm FROM embeddings),
reps AS (SELECT min(vec_id) AS rep, count(*) AS copies, e, any_value(norm) AS norm FROM unit GROUP BY e),
near AS MATERIALIZED (
  SELECT a.rep AS rep_a, b.rep AS rep_b, round(list_inner_product(a.e, b.e) / (a.norm * b.norm), 9) AS similarity
  FROM reps a JOIN reps b ON a.rep < b.rep
  WHERE round(list_inner_product(a.e, b.e) / (a.norm * b.norm), 9) >= {VECTOR_SIMILARITY})"""

_DBSCAN = f"""WITH RECURSIVE {_VECTORS},
both_ways AS (
  SELECT rep_a AS a, rep_b AS b FROM near UNION ALL SELECT rep_b, rep_a FROM near
  UNION ALL SELECT rep, rep FROM reps),
core AS (
  SELECT w.a AS rep FROM both_ways w JOIN reps r ON r.rep = w.b GROUP BY w.a HAVING sum(r.copies) >= 3),
reach AS (
  SELECT rep, rep AS other FROM core
  UNION SELECT r.rep, w.b FROM reach r JOIN both_ways w ON w.a = r.other WHERE w.b IN (SELECT rep FROM core)),
part AS (SELECT rep, min(other) AS root FROM reach GROUP BY rep),
numbered AS (SELECT rep, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM part),
labels AS (
  SELECT rep, cluster FROM numbered
  UNION ALL SELECT w.a, min(n.cluster) FROM both_ways w JOIN numbered n ON n.rep = w.b
  WHERE w.a NOT IN (SELECT rep FROM core) GROUP BY w.a)
SELECT u.vec_id AS position, CAST(coalesce(l.cluster, -1) AS BIGINT) AS semantic_cluster
FROM unit u JOIN reps r ON r.e = u.e LEFT JOIN labels l ON l.rep = r.rep"""


def _communities(rounds: int) -> str:
    steps = ["label0 AS (SELECT DISTINCT a AS account, a AS community FROM links)"]
    for n in range(1, rounds + 1):
        steps.append(f"""label{n} AS (
  SELECT account, community FROM (
    SELECT k.a AS account, l.community,
      row_number() OVER (PARTITION BY k.a ORDER BY sum(k.weight) DESC, l.community) AS pick
    FROM links k JOIN label{n - 1} l ON l.account = k.b GROUP BY k.a, l.community) WHERE pick = 1)""")
    return f"""WITH {_THREADS},
links AS (
  SELECT source AS a, target AS b, weight FROM shared UNION ALL SELECT target, source, weight FROM shared),
{", ".join(steps)}
SELECT account, community FROM label{rounds}"""


_TIP = """concat_ws(chr(10), s.account, 'connections: ' || s.degree, 'activity: ' || printf('%.0f', CAST(f.activity_count AS DOUBLE)),
    'signal score: ' || printf('%.3f', f.coordination_score),
    'new ≤7d: ' || CASE WHEN f.new_account_7d THEN 'True' ELSE 'False' END,
    'new ≤30d: ' || CASE WHEN f.new_account_30d THEN 'True' ELSE 'False' END,
    'max subreddit share: ' || printf('%.2f', f.max_subreddit_share))"""


def _preview(limit: int, gap_digits: int, missing: str) -> str:
    return f"""WITH {_FEATURES}, {_TOP}
SELECT author AS account, printf('%.0f', CAST(activity_count AS DOUBLE)) AS activity,
  printf('%.0f', CAST(post_count AS DOUBLE)) AS posts, printf('%.0f', CAST(comment_count AS DOUBLE)) AS comments,
  CASE WHEN new_account_7d THEN 'True' ELSE 'False' END AS new_7d,
  CASE WHEN new_account_30d THEN 'True' ELSE 'False' END AS new_30d,
  coalesce(printf('%.{gap_digits}f', median_interarrival_min), '{missing}') AS median_gap_min,
  printf('%.2f', max_subreddit_share) AS max_subreddit_share, printf('%.3f', coordination_score) AS signal_score
FROM top ORDER BY coordination_score DESC, author LIMIT {limit}"""


SQL: dict[str, str] = {
    "scan_activity": f"""WITH {_RAW}
SELECT id, kind, author, created_dt, subreddit, link_id, parent_id, score, md5(text) AS text_md5,
  length(text) AS chars FROM normal""",
    "publish_kind": f"""WITH {_RAW}
SELECT id, author, created_utc, CASE WHEN subreddit = '' THEN 'forum' ELSE subreddit END AS subreddit, score,
  title, md5(text) AS selftext_md5 FROM raw WHERE kind = 'post'""",
    "publish_manifest": f"""WITH {_ACTIVITY}
SELECT kind || 's' AS item, CAST(count(*) AS VARCHAR) AS value FROM activity GROUP BY kind
UNION ALL SELECT 'size', CASE WHEN count(*) < 1000 THEN 'n<1K' WHEN count(*) < 10000 THEN '1K<n<10K'
  WHEN count(*) < 100000 THEN '10K<n<100K' WHEN count(*) < 1000000 THEN '100K<n<1M'
  WHEN count(*) < 10000000 THEN '1M<n<10M' ELSE 'n>10M' END FROM activity
UNION ALL SELECT 'skipped', 'quiet_posts.parquet'""",
    "listed_subreddits": """SELECT CAST(position AS BIGINT) AS position, subreddit
FROM (VALUES (0, 'view'), (1, 'quiet'), (2, 'click')) named(position, subreddit)
UNION ALL SELECT row_number() OVER (ORDER BY event_type) + 2, event_type
FROM (SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'quiet', 'click'))""",
    "flatten_pages": f"""WITH {_RAW}
SELECT CAST(id AS BIGINT) // 100 AS page, id, author, created_utc, subreddit, score, link_id, parent_id FROM raw""",
    "dedupe_activity": f"""WITH {_LANDED}
SELECT id, author, subreddit, kind, created_utc, page, pos FROM landed WHERE id IS NULL
UNION ALL SELECT id, author, subreddit, kind, created_utc, page, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY page, pos) AS n FROM landed WHERE id IS NOT NULL)
WHERE n = 1""",
    "resume_cursor": f"""WITH {_LANDED}
SELECT kind, subreddit, CAST(max(CAST(created_utc AS BIGINT)) + 1 AS VARCHAR) AS next_after
FROM landed GROUP BY kind, subreddit""",
    "scan_window": f"""WITH {_ACTIVITY}
SELECT id, author, us AS created_dt, kind, subreddit, score, link_id, parent_id FROM activity
WHERE subreddit = 'click' AND us >= epoch_us(TIMESTAMP '2024-01-05') AND us < epoch_us(TIMESTAMP '2024-01-20')""",
    "normalize_activity": f"""WITH {_RAW}
SELECT id, kind, author, created_dt, md5(text) AS text_md5, length(text) AS chars FROM normal""",
    "norm_text": f"SELECT doc_id, {_norm('text')} AS norm_text FROM documents",
    "valid_activity": f"""WITH {_ACTIVITY}
SELECT id, author, us AS created_dt, kind, subreddit, score, link_id, parent_id FROM valid""",
    "eligible_activity": f"""WITH {_DOCS}
SELECT id, author, subreddit, md5(norm_text) AS norm_md5 FROM eligible""",
    "topic_hits": f"""WITH {_DOCS}
SELECT id, {", ".join(f"CAST({_hit('text', w)} AS BIGINT) AS {t}" for t, w in TOPICS.items())} FROM docs""",
    "account_features": f"""WITH {_RATES_CTE},{_FEATURE_CTES}
SELECT {_FEATURE_COLUMNS}, {", ".join(f"round({c}, 6) AS {c}" for c in _RATE_NAMES)}
FROM feat JOIN rates USING (author)""",
    "coordination_score": f"WITH {_FEATURES} SELECT author, {_SIGNAL_COLUMNS} FROM scored",
    "rank_candidates": f"WITH {_FEATURES}, {_TOP} SELECT {_FEATURE_COLUMNS}, {_SIGNAL_COLUMNS} FROM top",
    "candidate_preview": _preview(40, 2, "nan"),
    "candidate_preview_markdown": _preview(20, 1, ""),
    "feature_preview": f"""WITH {_FEATURES} SELECT {_FEATURE_COLUMNS}
FROM (SELECT * FROM feat ORDER BY new_account_7d DESC, activity_count DESC, author LIMIT 25)""",
    "author_subreddit_crosstab": f"""WITH {_ACTIVITY}
SELECT author, {", ".join(f"count(*) FILTER (WHERE subreddit = '{s}') AS {s}" for s in ("click", "error", "purchase", "signup", "view"))}
FROM valid GROUP BY author""",
    "topic_rates": f"""WITH {_RATES_CTE}
SELECT author, {", ".join(f"round({c}, 6) AS {c}" for c in _RATE_NAMES)} FROM rates""",
    "topic_summary": f"""WITH {_RATES_CTE}
{" UNION ALL ".join(f"SELECT '{t}' AS topic, round(avg(topic_{t}_rate), 6) AS mean_rate FROM rates" for t in TOPICS)}""",
    "daily_activity": f"""WITH {_ACTIVITY},
days AS (SELECT unnest(range(min(us // {_DAY}), max(us // {_DAY}) + 1)) AS day FROM activity)
SELECT CAST(CAST(make_timestamp(d.day * {_DAY}) AS DATE) AS VARCHAR) AS day, count(a.id) AS "rows"
FROM days d LEFT JOIN activity a ON a.us // {_DAY} = d.day GROUP BY d.day""",
    "new_account_daily_share": f"""WITH {_ACTIVITY},
days AS (SELECT unnest(range(min(us // {_DAY}), max(us // {_DAY}) + 1)) AS day FROM activity),
aged AS (SELECT us // {_DAY} AS day, us - min(us) OVER (PARTITION BY author) AS age FROM activity),
daily AS (
  SELECT d.day, count(a.age) AS total, count(*) FILTER (WHERE age <= 1 * {_DAY}) AS new_7d,
    count(*) FILTER (WHERE age <= 2 * {_DAY}) AS new_30d
  FROM days d LEFT JOIN aged a ON a.day = d.day GROUP BY d.day)
SELECT CAST(CAST(make_timestamp(day * {_DAY}) AS DATE) AS VARCHAR) AS day, total, new_7d, new_30d,
  round(new_7d / nullif(total, 0), 6) AS share_7d, round(new_30d / nullif(total, 0), 6) AS share_30d FROM daily""",
    "reply_edges": f"WITH {_REPLIES} SELECT author, parent_author, weight FROM replies",
    "shared_thread_edges": f"WITH {_THREADS} SELECT source, target, weight FROM shared",
    "temporal_pairs": f"""WITH {_THREADS},
met AS (
  SELECT DISTINCT a.link_id, a.author AS source, b.author AS target
  FROM valid a JOIN valid b ON a.link_id = b.link_id AND a.author < b.author AND abs(a.us - b.us) <= 900000000)
SELECT source, target, count(*) AS weight FROM met GROUP BY source, target""",
    "network_edges": f"WITH {_REPLIES} SELECT source, target, weight FROM network",
    "reply_graph": f"WITH {_REPLIES} SELECT source, target, weight FROM heavy",
    "node_degree": f"WITH {_REPLIES} SELECT account, degree, weighted_degree FROM degree",
    "top_degree_subgraph": f"""WITH {_REPLIES} SELECT source, target, weight FROM heavy
WHERE source IN (SELECT account FROM top50) AND target IN (SELECT account FROM top50)""",
    "top_degree_nodes": f"WITH {_REPLIES} SELECT account, degree FROM top50",
    "network_nodes": f"""WITH {_REPLIES},{_FEATURE_CTES}
SELECT s.account AS id, s.degree, least(22, 6 + s.degree) AS r,
  CASE WHEN f.new_account_7d THEN '#d85a30' WHEN f.coordination_score >= 0.5 THEN '#e0a106' ELSE '#3d6f8f' END AS color,
  {_TIP} AS tip
FROM shown s LEFT JOIN scored f ON f.author = s.account""",
    "network_links": f"""WITH {_REPLIES},
placed AS (SELECT account, row_number() OVER (ORDER BY degree DESC, account) - 1 AS at FROM shown)
SELECT a.at AS s, b.at AS t, weight AS w
FROM selected e JOIN placed a ON a.account = e.source JOIN placed b ON b.account = e.target""",
    "ego_neighbors": f"""WITH {_REPLIES}
SELECT account, rank, other, CASE WHEN outgoing = 1 THEN 'replied to' ELSE 'replied from' END AS direction, weight
FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY weight DESC, other, outgoing DESC) AS rank FROM ends)
WHERE rank <= 12""",
    "components": f"""WITH RECURSIVE {_THREADS},
links AS (
  SELECT source AS a, target AS b FROM shared WHERE weight >= 2
  UNION ALL SELECT target, source FROM shared WHERE weight >= 2),
reach AS (SELECT DISTINCT a AS account, a AS other FROM links
  UNION SELECT r.account, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT account, min(other) AS component FROM reach GROUP BY account""",
    "communities": _communities(3),
    "tfidf_vocabulary": f"WITH {_GRAMS} SELECT gram, df, cf, round(idf, 6) AS idf FROM vocab",
    "tfidf_weights": f"""WITH {_GRAMS},
keyed AS (
  SELECT sha256(t) AS key, min(id) AS id, count(*) AS copies FROM texts GROUP BY t)
SELECT key, copies, count(*) AS grams, round(sum(w), 6) AS weight_sum, round(max(w), 6) AS weight_max,
  round(sum(w * length(gram)), 6) AS weighted_length
FROM keyed JOIN weights USING (id) GROUP BY key, copies""",
    "topk_cosine": f"""WITH {_GRAMS},
alike AS MATERIALIZED (
  SELECT a.id AS id_a, b.id AS id_b, least(round(sum(a.w * b.w), 9), 1.0) AS similarity
  FROM weights a JOIN weights b ON a.gram = b.gram AND a.id < b.id GROUP BY a.id, b.id),
every AS (
  SELECT a.id AS id_a, b.id AS id_b, coalesce(s.similarity, 0.0) AS similarity
  FROM texts a JOIN texts b ON a.id < b.id LEFT JOIN alike s ON s.id_a = a.id AND s.id_b = b.id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY similarity DESC, id_b) + 1 AS rank
  FROM (SELECT * FROM every UNION ALL SELECT id_b, id_a, similarity FROM every))
SELECT id_a, rank, id_b, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 10""",
    "near_duplicate_pairs": f"WITH {_NEAR} SELECT * REPLACE (round(similarity, 6) AS similarity) FROM pairs",
    "near_duplicate_pairs_sparse_ids": f"""WITH {_GRAMS},
alike AS (
  SELECT a.id AS id_a, b.id AS id_b, least(round(sum(a.w * b.w), 9), 1.0) AS similarity
  FROM weights a JOIN weights b ON a.gram = b.gram AND a.id <> b.id
  GROUP BY a.id, b.id HAVING round(sum(a.w * b.w), 9) >= 0.88)
SELECT least(a.us, b.us) AS first, greatest(a.us, b.us) AS second, round(similarity, 6) AS similarity,
  md5(a.text) AS text_a, md5(b.text) AS text_b
FROM alike r JOIN eligible a ON a.id = r.id_a JOIN eligible b ON b.id = r.id_b WHERE a.author <> b.author""",
    "similar_text_edges": f"""WITH {_NEAR}
SELECT least(author_a, author_b) AS source, greatest(author_a, author_b) AS target, count(*) AS weight,
  round(max(similarity), 6) AS max_similarity FROM pairs GROUP BY ALL""",
    "latest_rows": f"""WITH {_ACTIVITY}
SELECT id, author, us AS created_dt, kind, subreddit, score, link_id, parent_id,
  row_number() OVER (ORDER BY us, id) - 1 AS position
FROM (SELECT * FROM activity ORDER BY us DESC, id DESC LIMIT 3000)""",
    "embed_texts": f"""WITH {_DOCS},
crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
  lambda x, s: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS tab),
words AS (SELECT id, list_filter(string_split(lower(text), ' '), lambda w: w <> '') AS w FROM docs),
grams AS (
  SELECT id, unnest(w) AS gram FROM words
  UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
marks AS (
  SELECT gram, xor(list_reduce(list_prepend(4294967295, list_transform(
    regexp_extract_all(hex(encode(gram)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda a, c: xor(a >> 8, tab[(xor(a, c) & 255) + 1])), 4294967295) % {2 * HASHED_DIMENSIONS} AS mark
  FROM (SELECT DISTINCT gram FROM grams), crc),
sums AS (
  SELECT id, mark // 2 AS dimension, sum(CASE WHEN mark % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v
  FROM grams JOIN marks USING (gram) GROUP BY ALL),
idf AS (SELECT dimension, ln((1 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS w FROM sums GROUP BY dimension),
weighted AS (SELECT id, dimension, CAST(v AS DOUBLE) * w AS v FROM sums JOIN idf USING (dimension))
SELECT id, dimension, round(CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE), 6) AS value
FROM weighted WHERE v <> 0 QUALIFY value <> 0""",
    "cosine_neighbors": f"WITH {_VECTORS} SELECT rep_a, rep_b, round(similarity, 6) AS similarity FROM near",
    "dbscan_labels": _DBSCAN,
    "dbscan_zero_vectors": _DBSCAN.replace(
        "FROM embeddings)", "FROM (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_transform(embedding, lambda x: x * 0) "
        "ELSE embedding END AS embedding FROM embeddings))").replace(
        "reps AS (SELECT min(vec_id) AS rep, count(*) AS copies, e, any_value(norm) AS norm FROM unit GROUP BY e)",
        "reps AS (SELECT min(vec_id) AS rep, count(*) AS copies, e, any_value(norm) AS norm FROM unit WHERE norm IS NOT NULL GROUP BY e)").replace(
        "FROM unit u JOIN reps r ON", "FROM unit u LEFT JOIN reps r ON"),
    "cluster_summary": f"""WITH v AS (
  SELECT label, 'u' || vec_id % 20 AS author, {_START} + vec_id * 60000000 AS us, 's' || vec_id % 3 AS subreddit
  FROM embeddings WHERE label >= 0)
SELECT CAST(label AS BIGINT) AS semantic_cluster, count(*) AS cluster_size, count(DISTINCT author) AS unique_accounts,
  min(us) AS first_time, max(us) AS last_time, string_agg(DISTINCT subreddit, ',' ORDER BY subreddit) AS subreddits
FROM v GROUP BY label""",
    "dataset_stats": f"""WITH {_ACTIVITY}, {_NEAR}
SELECT 'activity_rows' AS label, count(*) AS value FROM activity
UNION ALL SELECT 'accounts', count(DISTINCT author) FROM activity
UNION ALL SELECT 'near_duplicate_pairs', count(*) FROM pairs
UNION ALL SELECT 'embedded_rows', count(*) FROM embeddings
UNION ALL SELECT 'clustered_rows', count(*) FROM embeddings WHERE label >= 0
UNION ALL SELECT 'clusters', count(DISTINCT label) FROM embeddings WHERE label >= 0""",
}
