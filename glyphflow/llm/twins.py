r"""SQL twins (DuckDB) of the queries that plain SQL can express: op2, op5, op9 and op10.

The other six have none: a forest, an automaton's tokens, propagation in rounds, XXH64 fingerprints and exchange
clustering are no plain SQL. The twins share no step with the operators: words meet by joins on positions, windows and
strings by grouping all of them.
"""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES

#: Words of a text in lower case (A-Z only), as in the contract of op2 and op5.
WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def values(rows) -> str:
    """Rows of strings as a VALUES list."""
    return ", ".join("(" + ", ".join("'" + c.replace("'", "''") + "'" for c in r) + ")" for r in rows)


OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text")} AS w FROM documents),
phrases AS (SELECT row_number() OVER () AS k, string_split(p, ' ') AS w, label FROM (VALUES {values(PHRASES)}) v(p, label)),
templates AS (SELECT row_number() OVER () AS k, label, string_split(t, ' ') AS w, string_split(key, ' ') AS key_w,
    len(string_split(rtrim(split_part(' ' || t || ' ', ' ' || key || ' ', 1)), ' ')) - 1 AS key_at FROM (VALUES {values(TEMPLATES)}) v(label, key, t)),
wanted AS (SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM phrases UNION ALL SELECT w FROM templates)),
spots AS (SELECT r, i - 1 AS i, word FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) JOIN wanted USING (word)),
phrase_words AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS j, len(w) AS n FROM phrases),
key_words AS (SELECT k, unnest(key_w) AS word, generate_subscripts(key_w, 1) - 1 + key_at AS j, len(key_w) AS n FROM templates),
template_words AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS j, len(w) AS n FROM templates),
places AS (SELECT r, k, i - j AS place FROM spots JOIN phrase_words USING (word) GROUP BY r, k, place HAVING count(*) = any_value(n)),
keys AS (SELECT r, k, i - j AS place FROM spots JOIN key_words USING (word) GROUP BY r, k, place HAVING count(*) = any_value(n)),
frequency AS (SELECT word, count(DISTINCT r) AS files FROM spots GROUP BY word),
voters AS (SELECT r, k, word FROM (SELECT r, k, word, row_number() OVER (PARTITION BY r, k ORDER BY files, word) AS turn
    FROM (SELECT DISTINCT r, word FROM spots) JOIN (SELECT DISTINCT k, word FROM template_words) USING (word) JOIN frequency USING (word)) WHERE turn <= 6),
votes AS (SELECT r, k, i - j AS place FROM voters JOIN spots USING (r, word) JOIN template_words USING (k, word) GROUP BY r, k, place HAVING count(*) >= 3),
cover AS (SELECT r, k, place, count(*) / any_value(n) AS share FROM spots JOIN template_words USING (word) JOIN keys USING (r, k) SEMI JOIN votes USING (r, k, place) WHERE i - j = place GROUP BY r, k, place),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places JOIN phrases USING (k) GROUP BY r),
own AS (SELECT r, max(share) AS share FROM cover GROUP BY r),
named AS (SELECT r, label FROM places JOIN phrases USING (k) UNION SELECT r, label FROM cover JOIN templates USING (k) WHERE share >= 0.5),
labels AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM named GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN own USING (r) LEFT JOIN labels USING (r)
"""

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {WORDS.format("text")} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS words FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
cut AS (SELECT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: struct_pack(i := i, words := array_to_string(w[i:i + n - 1], ' ')))) AS x FROM d, sizes),
hits AS (SELECT r, n, x.i AS i, item FROM cut JOIN windows USING (n) WHERE x.words = windows.words),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN items USING (r)
"""

OP9 = """
WITH cut AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT r, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
parts AS (SELECT r, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM split),
rules AS (SELECT name, own, split_part(name, '/', 1) AS rule_host, substr(name, position('/' IN name)) AS rule_path FROM (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')) v(name, own)),
site AS (SELECT r, name, own, row_number() OVER (PARTITION BY r ORDER BY length(name) DESC, name) AS turn FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
topics AS (SELECT unnest(['adult', 'casino', 'cam', 'escort', 'keygen', 'lottery', 'pills', 'poker', 'porn', 'replica', 'roulette', 'sex', 'slots', 'spam', 'warez', 'xxx']) AS t),
tails AS (SELECT unnest(['bonus', 'club', 'farm', 'free', 'hub', 'live', 'mart', 'online', 'shop', 'tube', 'vip', 'win', 'x']) AS x),
ads AS (SELECT unnest(['ad', 'ads', 'adserver', 'advert', 'affiliate', 'banner', 'banners', 'beacon', 'pixel', 'popup', 'promo', 'sponsor', 'track', 'tracker', 'tracking']) AS a),
places AS (SELECT unnest(['click', 'collect', 'img', 'js', 'log', 'redirect', 'serve', 'view']) AS p),
patterns AS (SELECT '||' || t || '-' || x || '.' AS name, 'block' AS own, '.' || t || '-' || x || '.' AS in_host, '' AS in_path, '' AS page FROM topics, tails
    UNION ALL SELECT '||' || w || '.', 'block', '.' || w || '.', '', '' FROM (SELECT t AS w FROM topics UNION ALL SELECT a FROM ads)
    UNION ALL SELECT '||' || a || '-' || x || '.', 'block', '.' || a || '-' || x || '.', '', '' FROM ads, (SELECT unnest(['cdn', 'net', 'server', 'track']) AS x)
    UNION ALL SELECT '||' || a || '-*/' || p || '/', 'block', '.' || a || '-', '/' || p || '/', '' FROM ads, places
    UNION ALL SELECT '/' || a || '/' || p || '/', 'block', '', '/' || a || '/' || p || '/', '' FROM ads, places
    UNION ALL SELECT '/' || p || '^', 'block', '', '', p FROM (SELECT unnest(['login', 'signin', 'cart', 'checkout']) AS p)
    UNION ALL SELECT '@@||' || t || '-help.', 'allow', '.' || t || '-help.', '', '' FROM topics
    UNION ALL SELECT '@@||' || t || '.*/help/', 'allow', '.' || t || '.', '/help/', '' FROM topics),
fits AS (SELECT r, name, patterns.own, row_number() OVER (PARTITION BY r ORDER BY patterns.own, length(name) DESC, name) AS turn FROM (SELECT r, host, translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM parts) JOIN patterns
    ON CASE WHEN page <> '' THEN regexp_matches(low, '/' || page || '([^0-9a-z_.%-]|$)') ELSE (in_host = '' OR contains('.' || host, in_host)) AND contains(low, in_path) END)
SELECT page_id, host, path, site.name AS rule, coalesce(site.own, fits.own, 'allow') AS verdict, CASE WHEN site.name IS NULL THEN fits.name END AS pattern
FROM parts LEFT JOIN site ON site.r = parts.r AND site.turn = 1 LEFT JOIN fits ON fits.r = parts.r AND fits.turn = 1
"""

OP10 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT r, unnest(list_transform(range(1, octet_length(b) - 198), lambda i: struct_pack(i := i, h := md5_number(b[i:i + 199])))) AS x FROM d WHERE octet_length(b) >= 200),
repeated AS (SELECT x.h AS h FROM starts GROUP BY x.h HAVING count(*) > 1),
marked AS (SELECT r, x.i AS i, lag(x.i) OVER (PARTITION BY r ORDER BY x.i) AS before FROM starts JOIN repeated ON x.h = repeated.h),
numbered AS (SELECT r, i, count(*) FILTER (WHERE before IS NULL OR i > before + 200) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
runs AS (SELECT r, min(i) AS first, max(i) + 199 AS last FROM numbered GROUP BY r, run),
removed AS (SELECT r, sum(last - first + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r),
gaps AS (SELECT r, coalesce(lag(last) OVER (PARTITION BY r ORDER BY first), 0) + 1 AS first, first - 1 AS last FROM runs UNION ALL SELECT r, max(last) + 1, octet_length(any_value(b)) FROM runs JOIN d USING (r) GROUP BY r),
kept AS (SELECT r, string_agg(hex(b[first:last]), '' ORDER BY first) AS bytes FROM gaps JOIN d USING (r) WHERE first <= last GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(coalesce(bytes, '')) END) AS kept_sha256
FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""

SQL = {"op2_license_scan": OP2, "op5_decontaminate": OP5, "op9_url_rules": OP9, "op10_suffix_dedup": OP10}
