"""SQL (DuckDB dialect) for the queries that plain SQL can express, written on its own
terms: windows and joins on whole tables, no use of the engine's shortcuts."""

from __future__ import annotations

from accountlens.catalog.forests import ACCOUNT_FOREST, TEXT_FOREST, nodes_sql
from accountlens.catalog.tables import CLIENT_NAMES
from accountlens.functions.scalars import MOBILE_CLIENTS, WEB_CLIENT
from accountlens.schema import CLIENTS, FEATURE_COLUMNS, HOURS, WEEKDAYS

_EVENTS = """
ev AS (
  SELECT event_id, event_id AS id, ts, epoch_us(ts) // 1000000 AS sec, user_id, event_type, value, props,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
  FROM events
)"""


def _text(alias: str) -> str:
    return f"""
         list_unique(string_split({alias}.text, '')) * 1.0 / length({alias}.text) AS char_div,
         length({alias}.text) AS n_chars,
         len(string_split({alias}.text, ' ')) AS n_words,
         list_unique(string_split({alias}.text, ' ')) * 1.0 / len(string_split({alias}.text, ' ')) AS word_div"""


def _case(values: dict[str, str]) -> str:
    whens = " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {whens} END"


def _profiles(rows: str, keys: str = "user_id", prefix: str = "") -> str:
    """Newest profile of each group of posts, and the features made from it."""
    return f"""
{prefix}profile AS (
  SELECT {keys},
         CAST(value > 10 AS INTEGER) AS con_imagen_fondo,
         sec_cuenta,
         CASE WHEN k % 7 <> 0 THEN id % 1000 END AS n_favoritos,
         CAST(coalesce(length(description) > 0, false) AS INTEGER) AS con_descripcion,
         CAST(length(description) AS INTEGER) AS longitud_descripcion,
         CAST(event_type = 'purchase' AS INTEGER) AS con_perfil_verificado,
         CAST(k % 3 <> 0 AND k % 2 = 0 AS INTEGER) AS con_imagen_default,
         k % 7 AS n_listas,
         CAST(value > 50 AS INTEGER) AS con_geo_activo,
         k AS seguidores,
         CAST(floor(value) AS BIGINT) AS amigos,
         id AS n_tweets,
         event_type || user_id AS nombre_usuario
  FROM {rows} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY sec DESC, id DESC) = 1
),
{prefix}profile_feature AS (
  SELECT {keys}, con_imagen_fondo,
         strftime(make_timestamp(sec_cuenta * 1000000), '%Y-%m-%d %H:%M:%S') AS cuenta_creada,
         n_favoritos, con_descripcion, longitud_descripcion, con_perfil_verificado, con_imagen_default, n_listas,
         con_geo_activo, n_tweets, nombre_usuario,
         round(CASE WHEN seguidores + amigos > 0 THEN seguidores * 1.0 / (seguidores + amigos)
                    ELSE 0 END, 6) AS reputacion,
         round(CASE WHEN amigos > 0 THEN seguidores * 1.0 / amigos ELSE 0 END, 6) AS followers_ratio,
         CAST(year(make_timestamp(sec_cuenta * 1000000)) AS INTEGER) AS ano_registro
  FROM {prefix}profile
)"""


_POSTS = f"""{_EVENTS},
raw AS (
  SELECT ev.*, coalesce(d.text, ev.event_type || '  ' || ev.props) AS text, {_case(CLIENT_NAMES)} AS source,
         sec - k * 30 * 86400 AS sec_cuenta,
         CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 <> 1 THEN props END AS description
  FROM ev LEFT JOIN documents d ON d.doc_id = ev.event_id
),
post AS (
  SELECT raw.*, {_text("raw")},
         len(regexp_extract_all(text, 'https?://')) AS n_urls,
         len(regexp_extract_all(text, '#[A-Za-z0-9_]+')) AS n_hashtags,
         len(regexp_extract_all(text, '@[A-Za-z0-9_]+')) AS n_mentions,
         CASE WHEN event_type <> 'error' AND k <> 0 THEN 1 ELSE 0 END AS is_reply,
         CASE WHEN contains(source, '{WEB_CLIENT}') THEN 'uso_web'
              WHEN {" OR ".join(f"contains(source, '{m}')" for m in MOBILE_CLIENTS)} THEN 'uso_mobil'
              ELSE 'uso_terceros' END AS client,
         dayname(make_timestamp(sec * 1000000)) AS weekday,
         hour(make_timestamp(sec * 1000000)) AS hour
  FROM raw WHERE length(text) > 0
),{_profiles("post")}"""


def _shares(rows: str, group: str, values: dict[str, str]) -> str:
    """Share of rows of each group that satisfy each predicate."""
    columns = ",\n  ".join(
        f'round(count(*) FILTER (WHERE {p}) * 1.0 / count(*), 6) AS "{n}"' for n, p in values.items()
    )
    return f'SELECT {group}, count(*) AS "nroTweets",\n  {columns}\nFROM {rows} GROUP BY {group}'


_BY_WEEKDAY = {d: f"weekday = '{d}'" for d in WEEKDAYS}
_BY_HOUR = {h: f"hour = {i}" for i, h in enumerate(HOURS)}
_BY_CLIENT = {c: f"client = '{c}'" for c in CLIENTS}
_TEXT_MEANS = """round(avg(char_div), 6) AS avg_diversidad_lex, round(avg(n_chars), 6) AS avg_long_tweets,
  round(avg(n_words), 6) AS avg_palabras, round(avg(word_div), 6) AS avg_diversidad_palabras"""


def _post_features(rows: str) -> str:
    return f"""
SELECT user_id, count(*) AS "nroTweets",
  {", ".join(f'round(count(*) FILTER (WHERE {p}) * 1.0 / count(*), 6) AS "{n}"'
             for n, p in {**_BY_WEEKDAY, **_BY_HOUR, **_BY_CLIENT}.items())},
  {_TEXT_MEANS},
  round(avg(n_urls), 6) AS url_ratio, round(avg(n_hashtags), 6) AS avg_hashtags,
  round(avg(n_mentions), 6) AS mention_ratio, round(avg(is_reply), 6) AS reply_ratio,
  CAST(0 AS DOUBLE) AS avg_spam
FROM {rows} GROUP BY user_id"""


_POST_FEATURES = _post_features("post")


def _entropy(rows: str, group: str = "user_id", last: str = "110", longest: str = "n") -> str:
    """Gap series of each group's rows up to its entropies, searching every length up to ``longest``."""
    return f"""
gap AS (
  SELECT {group}, sec - lag(sec) OVER w AS gap, row_number() OVER w - 1 AS nth,
         count(*) OVER (PARTITION BY {group}) - 1 AS n_gaps
  FROM {rows} WINDOW w AS (PARTITION BY {group} ORDER BY ts, id)
),
series AS (
  SELECT {group}, gap, nth - 1 AS pos FROM gap WHERE n_gaps > 3 AND nth BETWEEN 2 AND {last}
),
bounds AS (
  SELECT {group}, min(gap) AS low, max(gap) AS high, count(*) AS n FROM series GROUP BY {group}
),
symbol AS (
  SELECT {group}, n, pos,
         CASE WHEN high = low THEN 0
              ELSE greatest(CAST(ceil((gap - low) * n / CAST(high - low AS DOUBLE)) AS BIGINT) - 1, 0) END AS q
  FROM series JOIN bounds USING ({group})
),
symbols AS (SELECT {group}, n, list(q ORDER BY pos) AS qs FROM symbol GROUP BY {group}, n),
lengths AS (SELECT {group}, n, qs, unnest(range(1, {longest} + 1)) AS l FROM symbols),
windows AS (SELECT {group}, n, l, qs, unnest(range(1, n - l + 2)) AS i FROM lengths),
counts AS (
  SELECT {group}, n, l, qs[i:i + l - 1] AS pattern, count(*) AS c FROM windows GROUP BY {group}, n, l, qs[i:i + l - 1]
),
shannon AS (
  SELECT {group}, n, l, -sum(c / CAST(n - l + 1 AS DOUBLE) * ln(c / CAST(n - l + 1 AS DOUBLE))) AS h,
         count(*) FILTER (WHERE c = 1) AS singles, CAST(sum(c) AS BIGINT) AS total
  FROM counts GROUP BY {group}, n, l
),
conditional AS (
  SELECT {group}, l, singles, total, h - lag(h) OVER (PARTITION BY {group} ORDER BY l) AS ce,
         first_value(h) OVER (PARTITION BY {group} ORDER BY l) AS h1
  FROM shannon
),
corrected AS (
  SELECT {group}, round(min(ce + singles / CAST(total AS DOUBLE) * h1), 6) AS entropia
  FROM conditional WHERE l >= 2 GROUP BY {group}
)"""


_SCORED = """
scored AS (
  SELECT l.doc_id, d.source, l.quality, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS pred
  FROM documents d JOIN labels l USING (doc_id)
)"""

_EVENT_CALENDAR = f"""
WITH {_EVENTS},
cal AS (SELECT *, dayname(ts) AS weekday, hour(ts) AS hour,
  CASE WHEN contains(event_type, 'click') OR contains(event_type, 'err') THEN 'uso_web'
       WHEN contains(event_type, 'view') OR contains(event_type, 'sign') THEN 'uso_mobil'
       ELSE 'uso_terceros' END AS client FROM ev)
"""

_TWO_CLASSES = """
two AS (
  SELECT post.*, CAST(0 AS DOUBLE) AS categoria FROM post WHERE id % 2 = 1
  UNION ALL
  SELECT post.*, CAST(1 AS DOUBLE) AS categoria FROM post WHERE id % 2 = 0
)"""

_SPACE = "[ \\t\\n\\x0b\\f\\r]"
_TOKENS = f"""
SELECT doc_id, CAST(len(regexp_split_to_array(regexp_replace(text, '{_SPACE}+$', ''), '{_SPACE}')) AS BIGINT) AS n_tokens
FROM documents"""


def _le(hex_text: str, first: str, n: int) -> str:
    """n bytes of a hex text as a little-endian number; ``first`` is the place of its first digit."""
    return "CAST('0x' || " + " || ".join(f"substr({hex_text}, {first} + {2 * i}, 2)" for i in reversed(range(n))) + " AS HUGEINT)"


def _scramble(k: str) -> str:
    once = f"(({k}) * 3432918353 % 4294967296)"
    return f"(({once} * 32768 % 4294967296 + {once} // 131072) * 461845907 % 4294967296)"


#: Hashed word counts (doc_id, bucket, n): murmur3 of 32 bits over the words' bytes, block by block.
_BUCKETS = f"""
words AS (
  SELECT doc_id, lower(w) AS w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '{_SPACE}+$', ''), '{_SPACE}')) AS w FROM documents)
  GROUP BY ALL
),
byte_text AS (SELECT w, hex(encode(w)) AS h, length(hex(encode(w))) // 2 AS size FROM (SELECT DISTINCT w FROM words)),
blocks AS (
  SELECT w, h, size, list_transform(range(0, size // 4), lambda i: {_scramble(_le("h", "8 * i + 1", 4))}) AS ks,
    CASE size % 4 {" ".join(f"WHEN {r} THEN {_scramble(_le('h', '8 * (size // 4) + 1', r))}" for r in (1, 2, 3))} ELSE 0 END AS rest
  FROM byte_text
),
folded AS (
  SELECT w, xor(xor(CAST(list_reduce(list_prepend(CAST(42 AS HUGEINT), ks),
    lambda a, k: ((xor(CAST(a AS UBIGINT), CAST(k AS UBIGINT))::HUGEINT * 8192 % 4294967296
      + xor(CAST(a AS UBIGINT), CAST(k AS UBIGINT))::HUGEINT // 524288) * 5 + 3864292196) % 4294967296) AS UBIGINT),
    CAST(rest AS UBIGINT)), CAST(size AS UBIGINT)) AS h0 FROM blocks
),
first_mix AS (SELECT w, CAST(xor(h0, h0 >> 16)::HUGEINT * 2246822507 % 4294967296 AS UBIGINT) AS h1 FROM folded),
second_mix AS (SELECT w, CAST(xor(h1, h1 >> 13)::HUGEINT * 3266489909 % 4294967296 AS UBIGINT) AS h2 FROM first_mix),
hashed AS (SELECT w, CAST(xor(h2, h2 >> 16) AS BIGINT) AS u FROM second_mix),
buckets AS (
  SELECT doc_id, ((CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) % 140 + 140) % 140 AS bucket,
    CAST(sum(n) AS BIGINT) AS n
  FROM words JOIN hashed USING (w) GROUP BY ALL
)"""


def _walk(nodes: str, rows: str, key: str, values: str, classes: int) -> str:
    """Leaves of each row in each tree, and the mean of their shares; ``values`` has (key, feature, value)."""
    means = ", ".join(f"avg(c{i} / ({' + '.join(f'c{j}' for j in range(classes))})) AS p_{i}" for i in range(classes))
    return f"""
forest AS (SELECT * FROM {nodes}),
walk AS (
  SELECT {key}, tree, 0 AS node FROM {rows}, (SELECT DISTINCT tree FROM forest)
  UNION ALL
  SELECT w.{key}, w.tree, CASE WHEN coalesce(v.value, 0) <= threshold THEN left_ ELSE right_ END
  FROM walk w JOIN forest n ON n.tree = w.tree AND n.node = w.node AND n.feature IS NOT NULL
    LEFT JOIN {values} v ON v.{key} = w.{key} AND v.feature = n.feature
),
votes AS (
  SELECT {key}, {means} FROM walk w JOIN forest n ON n.tree = w.tree AND n.node = w.node AND n.feature IS NULL
  GROUP BY {key}
)"""


ORACLES: dict[str, str] = {
    "json_extract": f"""
WITH {_POSTS}
SELECT id, user_id, k, CAST(n_chars AS BIGINT) AS n_chars, CAST(n_hashtags AS BIGINT) AS n_hashtags FROM
  (SELECT id, user_id, k, length(text) AS n_chars,
          len(regexp_extract_all(text, '#[A-Za-z0-9_]+')) AS n_hashtags FROM raw
   UNION ALL SELECT id, NULL, NULL, NULL, 0 FROM raw)""",
    "timeline_scan": f"""
WITH {_POSTS}
SELECT id, user_id, event_type || user_id AS nombre_usuario, source,
  CASE WHEN event_type <> 'error' THEN k END AS reply_to, length(text) AS n_chars,
  CAST(len(regexp_extract_all(text, '@[A-Za-z0-9_]+')) AS BIGINT) AS n_mentions
FROM raw""",
    "labelled_text_scan": """
SELECT doc_id AS id, length(text) AS n_chars, CAST(toxic AS DOUBLE) AS label FROM documents JOIN labels USING (doc_id)""",
    "table_roundtrip": f"""{_EVENT_CALENDAR}
SELECT user_id, {", ".join(f'"{d}"' for d in WEEKDAYS)} FROM ({_shares("cal", "user_id", _BY_WEEKDAY)})""",
    "retention_filter": """
SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3 DAY""",
    "appended_runs": f"""
WITH {_EVENTS}
SELECT event_id, CAST(k % 3 AS VARCHAR) AS run, strftime(ts, '%Y-%m-%d') AS day FROM ev WHERE k % 3 <> 1 OR k > 50""",
    "expired_rows": f"""
WITH {_EVENTS}
SELECT event_id, CAST(k % 2 AS VARCHAR) AS run FROM ev WHERE ts > TIMESTAMP '2024-01-15 13:30:00'""",
    "parse_created_at": "SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000000 AS sec FROM events",
    "calendar_parts": """
SELECT event_id, year(ts) AS ano, month(ts) AS mes, dayname(ts) AS dia, hour(ts) AS hora FROM events""",
    "truthy_flags": f"""
WITH {_EVENTS}
SELECT event_id,
  CAST(CASE WHEN event_type <> 'error' AND k <> 0 THEN 1 ELSE 0 END AS BIGINT) AS number_flag,
  CAST(CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE 1 END AS BIGINT) AS text_flag,
  CAST(CASE WHEN event_type <> 'click' AND value > 50 THEN 1 ELSE 0 END AS BIGINT) AS bool_flag
FROM ev""",
    "guarded_ratios": """
WITH d AS (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'click') AS clicks,
         count(*) FILTER (WHERE event_type = 'view') AS views
  FROM events GROUP BY ALL)
SELECT *, round(CASE WHEN clicks + views > 0 THEN clicks * 1.0 / (clicks + views) ELSE 0 END, 6) AS reputacion,
  round(CASE WHEN views > 0 THEN clicks * 1.0 / views ELSE 0 END, 6) AS followers_ratio
FROM d""",
    "nonempty_text": "SELECT lang, count(*) AS n_docs FROM documents WHERE length(text) > 0 GROUP BY lang",
    "fill_zero": """
WITH u AS (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id),
b AS (SELECT user_id, count(*) AS n_bought, round(sum(value), 2) AS spent FROM events
      WHERE event_type = 'purchase' AND CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY user_id)
SELECT user_id, n_events, coalesce(n_bought, 0) AS n_bought, coalesce(spent, 0) AS spent
FROM u LEFT JOIN b USING (user_id)""",
    "post_gaps": f"""
WITH {_EVENTS}
SELECT user_id, event_id, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM ev""",
    "gap_list": f"""
WITH {_EVENTS}, {_entropy("ev")}
SELECT user_id, count(*) AS n, string_agg(CAST(gap AS VARCHAR), ',' ORDER BY pos) AS series
FROM series GROUP BY user_id""",
    "min_history": f"""
WITH {_EVENTS},
a AS (SELECT user_id || ':' || event_type || ':' || CAST(k // 50 AS VARCHAR) AS account, event_id FROM ev)
SELECT account, event_id FROM a QUALIFY count(*) OVER (PARTITION BY account) - 1 > 3""",
    "account_post_count": 'SELECT user_id, count(event_type) AS "nroTweets" FROM events GROUP BY user_id',
    "weekday_profile": _EVENT_CALENDAR + _shares("cal", "user_id", _BY_WEEKDAY),
    "hour_profile": _EVENT_CALENDAR + _shares("cal", "user_id", _BY_HOUR),
    "client_profile": _EVENT_CALENDAR + _shares("cal", "user_id", _BY_CLIENT),
    "entity_ratios": """
SELECT regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, count(*) AS "nroTweets",
  round(avg(len(regexp_extract_all(html, 'href="'))), 6) AS url_ratio,
  round(avg(len(regexp_extract_all(html, '<li>'))), 6) AS avg_hashtags,
  round(avg(len(regexp_extract_all(html, '<p>'))), 6) AS mention_ratio
FROM pages GROUP BY 1""",
    "text_features": f"""
WITH t AS (SELECT source, {_text("documents")} FROM documents)
SELECT source, count(*) AS "nroTweets", {_TEXT_MEANS} FROM t GROUP BY source""",
    "reply_ratio": """
SELECT conv_id, count(*) AS "nroTweets",
  round(count(*) FILTER (WHERE role = 'assistant' AND turn <> 0) * 1.0 / count(*), 6) AS reply_ratio
FROM conversations GROUP BY conv_id""",
    "tokenize": _TOKENS,
    "hashing_tf_totals": _TOKENS,
    "hashing_tf": f"WITH {_BUCKETS} SELECT doc_id, bucket, n FROM buckets",
    "word_buckets": f"""
WITH {_BUCKETS}
SELECT w AS word, ((CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) % 140 + 140) % 140 AS bucket FROM hashed""",
    "forest_spam_rate": f"""
WITH RECURSIVE {_BUCKETS}, cells AS (SELECT doc_id, bucket AS feature, n AS value FROM buckets),
{_walk(nodes_sql(TEXT_FOREST), "documents", "doc_id", "cells", 2)}
SELECT source, round(avg(CASE WHEN p_1 > p_0 THEN 1 ELSE 0 END), 6) AS avg_spam
FROM documents JOIN votes USING (doc_id) WHERE text IS NOT NULL GROUP BY source""",
    "latest_profile": f"WITH {_POSTS} SELECT * FROM profile",
    "profile_features": f"WITH {_POSTS} SELECT *, CAST(0 AS DOUBLE) AS categoria FROM profile_feature",
    "post_features": f"WITH {_POSTS} {_POST_FEATURES}",
    "account_features": f"""
WITH {_POSTS}, {_entropy("post")}, pf AS ({_POST_FEATURES})
SELECT pf.*, p.* EXCLUDE (user_id) REPLACE (coalesce(n_favoritos, 0) AS n_favoritos,
         coalesce(longitud_descripcion, 0) AS longitud_descripcion),
  corrected.entropia, CAST(-1 AS DOUBLE) AS categoria
FROM pf JOIN profile_feature p USING (user_id) JOIN corrected USING (user_id)""",
    "account_features_labelled": f"""
WITH {_POSTS}, {_TWO_CLASSES}, {_entropy("two", "user_id, categoria")},
kept AS (SELECT two.* FROM two JOIN corrected USING (user_id, categoria)),
f AS (
  {_shares("kept", "user_id", {**_BY_WEEKDAY, **_BY_CLIENT})}
),
t AS (SELECT user_id, round(avg(n_chars), 6) AS avg_long_tweets FROM kept GROUP BY user_id),
newest AS (SELECT user_id, categoria, CAST(id AS DOUBLE) AS n_tweets FROM two
  QUALIFY row_number() OVER (PARTITION BY user_id, categoria ORDER BY sec DESC, id DESC) = 1)
SELECT c.user_id, c.categoria, c.entropia, f.* EXCLUDE (user_id), n_tweets, avg_long_tweets
FROM corrected c JOIN newest USING (user_id, categoria) JOIN f USING (user_id) JOIN t USING (user_id)""",
    "overlapping_accounts": f"""
WITH {_POSTS}, {_TWO_CLASSES}
SELECT user_id, '0.0,1.0' AS labels FROM two GROUP BY user_id HAVING count(DISTINCT categoria) > 1""",
    "gap_symbols": f"""
WITH {_EVENTS}, {_entropy("ev")}
SELECT user_id, string_agg(CAST(q AS VARCHAR), ',' ORDER BY pos) AS symbols FROM symbol GROUP BY user_id""",
    "pattern_counts": f"""
WITH {_EVENTS}, {_entropy("ev")}
SELECT user_id, l, array_to_string(pattern, '-') AS pattern, c AS occurrences FROM counts""",
    "shannon_entropy": f"""
WITH {_EVENTS}, {_entropy("ev")}
SELECT user_id, l, round(h, 6) AS h, singles, total FROM shannon""",
    "conditional_entropy": f"""
WITH {_EVENTS}, {_entropy("ev")}
SELECT user_id, l, round(ce, 6) AS ce, singles, total FROM conditional WHERE l >= 2""",
    "corrected_entropy": f"""
WITH {_EVENTS}, {_entropy("ev")}
SELECT user_id, entropia FROM corrected""",
    # patterns of 40 gaps don't occur twice; beyond them the term is least at the last length
    "whole_series_entropy": f"""
WITH {_EVENTS}, {_entropy("ev", "event_type", "n_gaps", "40")},
tail AS (SELECT event_type, h - ln(2) AS least FROM shannon WHERE l = 1)
SELECT event_type, round(least(least, (SELECT min(ce + singles / CAST(total AS DOUBLE) * h1) FROM conditional c
  WHERE c.event_type = tail.event_type AND l >= 2)), 6) AS entropia FROM tail""",
    "whole_series_repeats": f"""
WITH {_EVENTS}, {_entropy("ev", "event_type", "n_gaps", "40")}
SELECT event_type, l, count(*) AS n_patterns, CAST(sum(c) AS BIGINT) AS n_windows FROM counts
WHERE c > 1 GROUP BY event_type, l""",
    "label_union": """
SELECT doc_id, quality, CAST(CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 0 ELSE 2 END AS DOUBLE) AS categoria
FROM labels""",
    "split_train_test": """
SELECT doc_id,
  CASE WHEN CAST('0x' || substr(md5('1800009193|' || doc_id), 1, 8) AS BIGINT) % 100 < 20
       THEN 'test' ELSE 'train' END AS side
FROM documents""",
    "confusion_matrix": f"""
WITH {_SCORED}
SELECT CAST(t.c AS DOUBLE) AS quality, count(*) FILTER (WHERE quality = t.c AND pred = 0) AS pred_0,
  count(*) FILTER (WHERE quality = t.c AND pred = 1) AS pred_1,
  count(*) FILTER (WHERE quality = t.c AND pred = 2) AS pred_2
FROM (VALUES (0), (1), (2)) t(c) LEFT JOIN scored ON scored.quality = t.c GROUP BY t.c""",
    "accuracy": f"""
WITH {_SCORED} SELECT round(avg(CASE WHEN quality = pred THEN 1 ELSE 0 END), 6) AS accuracy FROM scored""",
    "prediction_rate": f"WITH {_SCORED} SELECT source, round(avg(pred), 6) AS avg_spam FROM scored GROUP BY source",
    "verdicts": 'SELECT DISTINCT user_id, CAST(3 AS BIGINT) AS n_classes, CAST(1 AS DOUBLE) AS total FROM events',
    "model_roundtrip": "SELECT doc_id, true AS agrees FROM documents",
    "score_stream": "SELECT DISTINCT user_id, true AS agrees FROM events",
}
# Feature values are doubles on both sides.
for _name in ("account_features",):
    ORACLES[_name] = f"""
SELECT * REPLACE ({", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in FEATURE_COLUMNS)})
FROM ({ORACLES[_name]})"""

_NUMBERS = ", ".join(f"('{c}', {i})" for i, c in enumerate(FEATURE_COLUMNS))
_VALUES = f"""
feature_rows AS (SELECT * FROM ({ORACLES["account_features"]})),
cells AS (
  SELECT user_id, number AS feature, value FROM (
    UNPIVOT (SELECT user_id, {", ".join(f'"{c}"' for c in FEATURE_COLUMNS)} FROM feature_rows)
    ON COLUMNS(* EXCLUDE (user_id)) INTO NAME name VALUE value)
  JOIN (VALUES {_NUMBERS}) numbers(name, number) USING (name)
)"""
ORACLES["forest_scores"] = f"""
WITH RECURSIVE {_VALUES}, {_walk(nodes_sql(ACCOUNT_FOREST), "feature_rows", "user_id", "cells", 3)}
SELECT user_id, round(p_0, 6) AS p_0, round(p_1, 6) AS p_1, round(p_2, 6) AS p_2,
  CAST(CASE WHEN p_0 >= p_1 AND p_0 >= p_2 THEN 0 WHEN p_1 >= p_2 THEN 1 ELSE 2 END AS DOUBLE) AS "Predicted_categoria"
FROM votes"""
ORACLES["node_importance"] = f"""
WITH {_VALUES}, forest AS (SELECT * FROM {nodes_sql(ACCOUNT_FOREST)}),
gains AS (SELECT tree, feature, sum(gain * (c0 + c1 + c2)) AS g FROM forest WHERE feature IS NOT NULL GROUP BY ALL),
shares AS (SELECT feature, g / sum(g) OVER (PARTITION BY tree) AS s FROM gains),
means AS (SELECT feature, avg(value) AS mean FROM cells GROUP BY feature)
SELECT name AS feature, round(coalesce((SELECT sum(s) FROM shares WHERE shares.feature = number), 0) / 3, 6) AS importance,
  round(mean, 3) AS mean
FROM (VALUES {_NUMBERS}) numbers(name, number) JOIN means ON means.feature = number"""

ORACLES["account_features_two_classes"] = f"""
WITH {_POSTS}, {_TWO_CLASSES}, {_entropy("two", "user_id, categoria")},{_profiles("two", "user_id, categoria", "own_")},
kept AS (SELECT two.* FROM two JOIN corrected USING (user_id, categoria)),
pf AS ({_post_features("kept")}),
whole AS (
  SELECT pf.*, p.* EXCLUDE (user_id) REPLACE (coalesce(n_favoritos, 0) AS n_favoritos,
         coalesce(longitud_descripcion, 0) AS longitud_descripcion), entropia
  FROM corrected JOIN own_profile_feature p USING (user_id, categoria) JOIN pf USING (user_id))
SELECT * REPLACE ({", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in FEATURE_COLUMNS)}) FROM whole"""
