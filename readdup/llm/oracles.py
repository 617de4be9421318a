"""DuckDB SQL for the queries that SQL can express, by name."""

from __future__ import annotations

from .mixing import MOST_SHARDS, SHARD_WORDS

_WORDS = "regexp_extract_all({t}, '[^\\x20\\x09-\\x0D]+')"
_SEED, _BLOCK = 17, 16


def _seats(table: str, group: str, votes: str, seats: str, key: str, out: str) -> str:
    """Common table expressions of highest quotients: ``{out}_f`` rounds, ``{out}_m`` moves seats, ``{out}`` joins."""
    part = f"PARTITION BY {group}" if group else ""
    pick = f"{group}, " if group else ""
    same = " AND ".join(f"f.{c} IS NOT DISTINCT FROM m.{c}" for c in [x for x in (group, key) if x])
    return f"""
{out}_r AS (SELECT *, sum({votes}) OVER ({part}) AS tot FROM {table}),
{out}_f AS (SELECT *, CASE WHEN tot > 0 THEN floor({votes}::DOUBLE * {seats} / tot::DOUBLE + 0.5)::BIGINT ELSE 0 END AS r FROM {out}_r),
{out}_e AS (SELECT *, CASE WHEN tot > 0 THEN (sum(r) OVER ({part}))::BIGINT - {seats} ELSE 0 END AS e FROM {out}_f),
{out}_s AS (SELECT *, CASE WHEN e > 0 THEN r - k ELSE r + k - 1 END AS seat FROM (SELECT *, unnest(range(1, abs(e)::BIGINT + 1)) AS k FROM {out}_e WHERE e <> 0)),
{out}_q AS (SELECT *, {votes}::DOUBLE / (2 * seat + 1) AS quotient FROM {out}_s WHERE seat >= 0),
{out}_n AS (SELECT *, CASE WHEN e > 0 THEN row_number() OVER ({part} ORDER BY quotient, {key} DESC NULLS FIRST) ELSE row_number() OVER ({part} ORDER BY -quotient, {key} NULLS LAST) END AS nth FROM {out}_q),
{out}_m AS (SELECT {pick}{key}, sum(CASE WHEN e > 0 THEN -1 ELSE 1 END)::BIGINT AS moved FROM {out}_n WHERE nth <= abs(e) GROUP BY {pick}{key}),
{out} AS (SELECT f.*, f.r + coalesce(m.moved, 0) AS {out}_seats FROM {out}_e f LEFT JOIN {out}_m m ON {same})"""


MIX = f"""WITH sized AS (SELECT doc_id, source, len({_WORDS.format(t="coalesce(text, '')")})::BIGINT AS size, md5('{_SEED}:' || coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM per),
level AS (SELECT *, 150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
  100 * sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den FROM named),
opened AS (SELECT *, num * weight <= den * 2 * source_size AS open FROM level),
found AS (SELECT *, first_value(num) OVER w AS num1, first_value(den) OVER w AS den1, max(open::INT) OVER () = 1 AS any_open FROM opened WINDOW w AS (ORDER BY open DESC, 2 * source_size / weight, source NULLS LAST)),
goal AS (SELECT source, source_size, CASE WHEN any_open AND num1 * weight <= den1 * 2 * source_size THEN weight::DOUBLE * num1::DOUBLE / den1::DOUBLE ELSE (2 * source_size)::DOUBLE END AS target FROM found),
seats AS (SELECT *, round(sum(target) OVER () / {_BLOCK})::BIGINT AS seats FROM goal),
{_seats("seats", "", "target", "seats", "source", "quota")},
given AS (SELECT source, source_size, target, quota_seats, least({MOST_SHARDS}, ceil(source_size / {SHARD_WORDS}.0) + 1)::BIGINT AS shards FROM quota),
placed AS (SELECT s.*, g.source_size, g.target, g.quota_seats, ('0x' || substr(ord, 1, 8))::BIGINT % g.shards AS shard FROM sized s JOIN given g ON s.source IS NOT DISTINCT FROM g.source),
shard AS (SELECT source, shard, quota_seats, sum(size)::BIGINT AS shard_size FROM placed GROUP BY source, shard, quota_seats),
{_seats("shard", "source", "shard_size", "quota_seats", "shard", "blocks")},
cut AS (SELECT source, shard, shard_size, least(blocks_seats * {_BLOCK}, 2 * shard_size) AS most,
  (('0x' || substr(md5('{_SEED}:' || coalesce(source, '') || ':' || shard::VARCHAR), 1, 8))::BIGINT % ceil(shard_size / {_BLOCK}.0)::BIGINT) * {_BLOCK} AS beg FROM blocks WHERE shard_size > 0),
laid AS (SELECT p.*, sum(size) OVER (PARTITION BY source, shard ORDER BY ord, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS hi FROM placed p),
spot AS (SELECT r.*, r.hi - r.size AS lo, c.most // c.shard_size AS turns, c.most % c.shard_size AS rest, c.beg, c.shard_size FROM laid r LEFT JOIN cut c ON r.source IS NOT DISTINCT FROM c.source AND r.shard = c.shard)
SELECT doc_id, size, source_size, target, coalesce(size * turns + greatest(0, least(hi, least(beg + rest, shard_size)) - greatest(lo, beg)) + greatest(0, least(hi, beg + rest - shard_size) - greatest(lo, 0)), 0)::BIGINT AS taken, source FROM spot"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE []::VARCHAR[] END) AS set FROM w),
g AS (SELECT doc_id, unnest(set) AS gram, len(set) AS n FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, len(set)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.least, s.doc_id)) AS component_id FROM s LEFT JOIN (SELECT node, min(other) AS least FROM reach GROUP BY node) m ON s.doc_id = m.node"""

SQL = {"op1_mix_sources": MIX, "op2_ngram_jaccard": JACCARD}
