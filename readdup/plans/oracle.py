"""The plan's frames as DuckDB SQL, one common table expression each, written apart from the DataFrame code."""

from __future__ import annotations

import re

from ..sources.fixture import READ_GROUPS_SQL, reads_sql

REF_LEN = "coalesce(list_sum(list_transform(regexp_extract_all({c}, '(\\d+)[MDN=X]', 1), lambda x: x::INT)), 0)"
LEAD = "(coalesce(TRY_CAST(regexp_extract({c}, '^(?:(\\d+)H)?(?:(\\d+)S)?', 1) AS INT), 0) + coalesce(TRY_CAST(regexp_extract({c}, '^(?:(\\d+)H)?(?:(\\d+)S)?', 2) AS INT), 0))"
TRAIL = "(coalesce(TRY_CAST(regexp_extract({c}, '(\\d+)S(?:\\d+H)?$', 1) AS INT), 0) + coalesce(TRY_CAST(regexp_extract({c}, '(\\d+)H$', 1) AS INT), 0))"
FIVE = "CASE WHEN {rev} THEN {pos} + " + REF_LEN + " - 1 + " + TRAIL + " ELSE {pos} - " + LEAD + " END"
QUALS = "list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)"
SCORE = f"least(list_sum(list_transform({QUALS}, lambda q: CASE WHEN q >= 15 THEN q ELSE 0 END)), 16383) - CASE WHEN (flag & 512) <> 0 THEN 16384 ELSE 0 END"
INT = "TRY_CAST(nullif(regexp_extract({f}, '^(-?[0-9]+)', 1), '') AS INT)"
_parts = "string_split(qname, ':')"
_ok = f"len({_parts}) IN (5, 7) AND " + " AND ".join(INT.format(f=f"{_parts}[{i}]") + " IS NOT NULL" for i in (-3, -2, -1))
LOCATION = ", ".join(f"CASE WHEN {_ok} THEN {INT.format(f=f'{_parts}[{i}]')} END AS {n}" for i, n in ((-3, "tile"), (-2, "x"), (-1, "y")))


def _orient(a: str, b: str) -> str:
    return f"CASE WHEN {a} AND {b} THEN 4 WHEN {a} THEN 5 WHEN {b} THEN 3 ELSE 2 END"


def _sets(barcodes: str = "") -> str:
    key = f"library, {barcodes}ref1, coord1, orientation, ref2, coord2"
    best = f"PARTITION BY {key} ORDER BY score DESC, coalesce(tile, -1), coalesce(x, -1), coalesce(y, -1), idx1, idx2"
    return f"""SELECT *, first_value(idx1) OVER ({best}) AS rep_idx, count(*) OVER (PARTITION BY {key}) AS set_size, row_number() OVER ({best}) AS rank,
  CASE WHEN max((optical_orientation = 3)::INT) OVER (PARTITION BY {key}) = 1 AND max((optical_orientation = 5)::INT) OVER (PARTITION BY {key}) = 1 THEN optical_orientation ELSE 0 END AS optical_group
  FROM pairs"""


def _times(a: str, b: int) -> str:
    """a * b modulo 2^32 in 64 bits."""
    return f"(((({a}) & 65535) * {b} + ((((({a}) >> 16) * {b}) & 65535) << 16)) & 4294967295)"


def _turned(x: str, bits: int) -> str:
    return f"(((({x}) << {bits}) & 4294967295) | (({x}) >> {32 - bits}))"


def _scrambled(k: str) -> str:
    return _times(_turned(_times(k, 0xCC9E2D51), 15), 0x1B873593)


_unclipped_start = f"pos - {LEAD.format(c='cigar')}"
_unclipped_end = f"pos + {REF_LEN.format(c='cigar')} - 1 + {TRAIL.format(c='cigar')}"
TABLES = {
    "reads": reads_sql().strip(),
    "groups": READ_GROUPS_SQL.strip(),
    "libs": "SELECT r.*, coalesce(g.library, 'Unknown Library') AS library, CASE WHEN r.rg IS NULL THEN 0 ELSE coalesce(g.rg_ordinal, (SELECT count(*) FROM groups)) END AS rg_ordinal FROM reads r LEFT JOIN groups g ON r.rg = g.rg_id",
    "ends": f"""SELECT idx, qname, rg, library, rg_ordinal, tid AS ref, {FIVE.format(c='cigar', pos='pos', rev='(flag & 16) <> 0')} AS coord, (flag & 16) <> 0 AS reverse, {SCORE} AS score,
  (flag & 9) = 1 AS has_mate, CASE WHEN (flag & 9) = 1 THEN mtid ELSE -1 END AS mate_ref, (flag & 64) <> 0 AS first, {LOCATION}, bc AS barcode, rx, mc, pos, mpos, mtid, flag, CASE WHEN (flag & 65) <> 1 THEN bx END AS slot1, CASE WHEN (flag & 65) = 1 THEN bz END AS slot2 FROM libs WHERE (flag & 2308) = 0""",
    "mated": "SELECT *, (row_number() OVER (PARTITION BY rg, qname ORDER BY idx) - 1) // 2 AS two FROM ends WHERE has_mate",
    "joined": "SELECT a, b FROM mated a JOIN mated b ON a.rg = b.rg AND a.qname = b.qname AND a.two = b.two AND a.idx < b.idx WHERE a.mate_ref = b.ref AND b.mate_ref = a.ref",
    "turned": "SELECT a, b, CASE WHEN (b.ref > a.ref) OR (b.ref = a.ref AND b.coord >= a.coord) THEN a ELSE b END AS p, CASE WHEN (b.ref > a.ref) OR (b.ref = a.ref AND b.coord >= a.coord) THEN b ELSE a END AS q FROM joined",
    "pairs": f"""SELECT p.idx AS idx1, q.idx AS idx2, a.library AS library, a.rg_ordinal AS rg_ordinal, p.ref AS ref1, p.coord AS coord1, q.ref AS ref2, q.coord AS coord2,
  CASE WHEN p.ref = q.ref AND p.coord = q.coord AND {_orient('p.reverse', 'q.reverse')} = 5 THEN 3 ELSE {_orient('p.reverse', 'q.reverse')} END AS orientation,
  CASE WHEN b.first THEN {_orient('b.reverse', 'a.reverse')} ELSE {_orient('a.reverse', 'b.reverse')} END AS optical_orientation, a.score + b.score AS score, a.tile AS tile, a.x AS x, a.y AS y, a.barcode AS barcode, coalesce(a.slot1, b.slot1) AS slot1, coalesce(a.slot2, b.slot2) AS slot2, ua.umi AS umi
  FROM turned LEFT JOIN umis ua ON ua.idx = a.idx""",
    "umis": "SELECT idx, CASE WHEN strand = 'bottom' THEN concat(string_split(rx, '-')[2], '-', string_split(rx, '-')[1]) ELSE rx END AS umi FROM strands",
    "sets": _sets(),
    "barcode_sets": _sets("barcode, "),
    "slot_sets": _sets("slot1, slot2, "),
    "umi_sets": _sets("umi, "),
    "pair_dups": "SELECT DISTINCT unnest([idx1, idx2]) AS idx FROM sets WHERE rank > 1",
    "frags": """SELECT *, max(has_mate::INT) OVER (PARTITION BY library, ref, coord, reverse) AS any_mate,
  row_number() OVER (PARTITION BY library, ref, coord, reverse, has_mate ORDER BY score DESC, coalesce(tile, -1), coalesce(x, -1), coalesce(y, -1), idx) AS rank FROM ends""",
    "frag_dups": "SELECT idx FROM frags WHERE NOT has_mate AND (any_mate = 1 OR rank > 1)",
    "dups": "SELECT idx FROM pair_dups UNION ALL SELECT idx FROM frag_dups",
    "edges": """SELECT u.rep_idx, u.optical_group, u.library, u.idx1 AS u, v.idx1 AS v FROM sets u JOIN sets v ON u.rep_idx = v.rep_idx AND u.optical_group = v.optical_group AND u.rg_ordinal = v.rg_ordinal AND u.tile = v.tile
  WHERE u.idx1 < v.idx1 AND abs(u.x - v.x) <= 100 AND abs(u.y - v.y) <= 100 AND u.set_size BETWEEN 2 AND 300000""",
    "both_ways": "SELECT rep_idx, u, v FROM edges UNION ALL SELECT rep_idx, v, u FROM edges",
    "reach": "SELECT rep_idx, u AS node, u AS least FROM both_ways UNION SELECT r.rep_idx, e.v, r.least FROM reach r JOIN both_ways e ON r.rep_idx = e.rep_idx AND r.node = e.u",
    "comps": "SELECT rep_idx, node, min(least) AS cluster FROM reach GROUP BY rep_idx, node",
    "optical": """SELECT idx1, idx2, library, rep_idx, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY s.rep_idx, c.cluster ORDER BY CASE WHEN s.rank = 1 THEN 0 ELSE 1 END, s.x, s.y, coalesce(s.tile, -1), s.idx1, s.idx2) AS place
  FROM sets s JOIN comps c ON s.rep_idx = c.rep_idx AND s.idx1 = c.node) WHERE place > 1""",
    "opt_ids": "SELECT DISTINCT unnest([idx1, idx2]) AS idx FROM optical WHERE rank > 1",
    "marks": """SELECT l.*, l.idx IN (SELECT idx FROM dups) AS is_duplicate, l.idx IN (SELECT idx FROM opt_ids) AS is_optical,
  CASE WHEN l.idx IN (SELECT idx FROM dups) THEN l.flag | 1024 ELSE l.flag & ~1024 END AS new_flag FROM libs l""",
    "raw": """SELECT library,
  count(*) FILTER (WHERE (flag & 2308) = 0 AND (flag & 9) <> 1) AS UNPAIRED_READS_EXAMINED, count(*) FILTER (WHERE (flag & 2308) = 0 AND (flag & 9) = 1) AS READ_PAIRS_EXAMINED,
  count(*) FILTER (WHERE (flag & 4) = 0 AND (flag & 2304) <> 0) AS SECONDARY_OR_SUPPLEMENTARY_RDS, count(*) FILTER (WHERE (flag & 4) <> 0) AS UNMAPPED_READS,
  count(*) FILTER (WHERE (flag & 2308) = 0 AND (flag & 9) <> 1 AND is_duplicate) AS UNPAIRED_READ_DUPLICATES, count(*) FILTER (WHERE (flag & 2308) = 0 AND (flag & 9) = 1 AND is_duplicate) AS READ_PAIR_DUPLICATES
  FROM marks GROUP BY library""",
    "opt_lib": "SELECT library, count(*) AS optical FROM optical GROUP BY library",
    "halved": """SELECT r.library, UNPAIRED_READS_EXAMINED, READ_PAIRS_EXAMINED // 2 AS READ_PAIRS_EXAMINED, SECONDARY_OR_SUPPLEMENTARY_RDS, UNMAPPED_READS, UNPAIRED_READ_DUPLICATES, READ_PAIR_DUPLICATES // 2 AS READ_PAIR_DUPLICATES, coalesce(o.optical, 0) AS READ_PAIR_OPTICAL_DUPLICATES
  FROM raw r LEFT JOIN opt_lib o ON r.library = o.library""",
    "bound": """SELECT library, (READ_PAIRS_EXAMINED - READ_PAIR_OPTICAL_DUPLICATES)::DOUBLE AS n, (READ_PAIRS_EXAMINED - READ_PAIR_DUPLICATES)::DOUBLE AS c, 100.0::DOUBLE AS high, 0 AS i FROM halved
  UNION ALL SELECT library, n, c, CASE WHEN c / (high * c) - 1 + exp(-n / (high * c)) > 0 THEN high * 10 ELSE high END, i + 1 FROM bound WHERE i < 12 AND n > 0 AND n - c > 0""",
    "bisect": """SELECT library, n, c, 1.0::DOUBLE AS low, high, 0 AS i, FALSE AS done FROM bound WHERE i = 12
  UNION ALL SELECT library, n, c, CASE WHEN NOT done AND u > 0 THEN r ELSE low END, CASE WHEN NOT done AND u < 0 THEN r ELSE high END, i + 1, done OR u = 0
  FROM (SELECT *, (low + high) / 2 AS r, c / ((low + high) / 2 * c) - 1 + exp(-n / ((low + high) / 2 * c)) AS u FROM bisect WHERE i < 40)""",
    "sizes": "SELECT library, CAST(trunc(c * (low + high) / 2) AS BIGINT) AS size FROM bisect WHERE i = 40",
    "final": """SELECT h.*, CASE WHEN UNPAIRED_READS_EXAMINED + 2 * READ_PAIRS_EXAMINED > 0 THEN (UNPAIRED_READ_DUPLICATES + 2 * READ_PAIR_DUPLICATES)::DOUBLE / (UNPAIRED_READS_EXAMINED + 2 * READ_PAIRS_EXAMINED)::DOUBLE ELSE 0.0 END AS PERCENT_DUPLICATION,
  s.size AS ESTIMATED_LIBRARY_SIZE FROM halved h LEFT JOIN sizes s ON h.library = s.library""",
    "set_opt": "SELECT s.rep_idx, s.set_size, coalesce(o.n, 0) AS n FROM sets s LEFT JOIN (SELECT rep_idx, count(*) AS n FROM optical GROUP BY rep_idx) o ON s.rep_idx = o.rep_idx WHERE s.rank = 1",
    "bins": "SELECT set_size AS bin, 0 AS kind FROM set_opt UNION ALL SELECT n + 1, 1 FROM set_opt WHERE n > 0 UNION ALL SELECT set_size - n, 2 FROM set_opt WHERE set_size > n",
    "histograms": "SELECT bin::DOUBLE AS bin, count(*) FILTER (WHERE kind = 0)::DOUBLE AS all_sets, count(*) FILTER (WHERE kind = 1)::DOUBLE AS optical_sets, count(*) FILTER (WHERE kind = 2)::DOUBLE AS non_optical_sets FROM bins GROUP BY bin",
    "strands": f"""SELECT *, CASE WHEN (flag & 12) = 0 AND (flag & 1) <> 0 THEN CASE WHEN ((flag & 64) <> 0) = (CASE WHEN tid <> mtid THEN tid < mtid
  ELSE ({FIVE.format(c='cigar', pos='pos', rev='(flag & 16) <> 0')}) <= ({FIVE.format(c='mc', pos='mpos', rev='(flag & 32) <> 0')}) END) THEN 'top' ELSE 'bottom' END END AS strand FROM reads""",
    "flow_cells": f"SELECT *, CASE WHEN (flag & 16) <> 0 THEN list_reverse(string_split(seq, '')) ELSE string_split(seq, '') END AS b, CASE WHEN (flag & 16) <> 0 THEN list_reverse({QUALS}) ELSE {QUALS} END AS q FROM reads",
    "flow_bases": "SELECT idx, flag, unnest(b) AS base, unnest(q) AS qual, generate_subscripts(b, 1) AS i FROM flow_cells",
    "flow_runs": "SELECT *, sum(fresh) OVER (PARTITION BY idx ORDER BY i) AS run FROM (SELECT *, CASE WHEN base = lag(base) OVER (PARTITION BY idx ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM flow_bases)",
    "turns": "SELECT DISTINCT qname FROM libs WHERE idx IN (SELECT idx FROM dups)",
    "mur_cells": """SELECT idx, flag, len(qname) AS size, list_transform(range(1, len(qname) + 1), lambda i: ascii(qname[i])::BIGINT) AS code FROM reads""",
    "mur_mixed": f"""SELECT idx, flag, size, list_transform(range(1, size // 2 + 1), lambda i: {_scrambled('(code[2 * i - 1] | (code[2 * i] << 16))')}) AS pair, CASE WHEN size % 2 = 1 THEN {_scrambled('code[size]')} ELSE 0 END AS rest FROM mur_cells""",
    "mur_body": "SELECT idx, flag, list_reduce(list_prepend(1::BIGINT, pair), lambda h, k: (((((xor(h, k) << 13) & 4294967295) | (xor(h, k) >> 19)) * 5) + 3864292196) & 4294967295) AS h, rest, size FROM mur_mixed",
    "mur_a": "SELECT idx, flag, xor(xor(h, rest), 2 * size) AS h FROM mur_body",
    "mur_b": f"SELECT idx, flag, {_times('xor(h, h >> 16)', 0x85EBCA6B)} AS h FROM mur_a",
    "mur_c": f"SELECT idx, flag, {_times('xor(h, h >> 13)', 0xC2B2AE35)} AS h FROM mur_b",
    "flow_reads": """SELECT l.*, coalesce(g.flow_order, 'TGCA') AS fo FROM libs l LEFT JOIN groups g ON l.rg = g.rg_id WHERE (l.flag & 2308) = 0 AND (l.flag & 1) = 0""",
    "flow_each": "SELECT idx, fo, unnest(bases) AS base, generate_subscripts(bases, 1) AS i FROM (SELECT idx, fo, CASE WHEN (flag & 16) <> 0 THEN list_reverse(string_split(seq, '')) ELSE string_split(seq, '') END AS bases FROM flow_reads)",
    "flow_starts": "SELECT *, lag(base) OVER (PARTITION BY idx ORDER BY i) AS prior FROM flow_each QUALIFY prior IS NULL OR prior <> base",
    "flow_steps": "SELECT idx, i, sum(CASE WHEN prior IS NULL THEN strpos(fo, base) - 1 ELSE (strpos(fo, base) - strpos(fo, prior) + len(fo)) % len(fo) END) OVER (PARTITION BY idx ORDER BY i) AS flow FROM flow_starts",
    "flow_walk": "SELECT r.idx, coalesce((SELECT min(s.i) - 1 FROM flow_steps s WHERE s.idx = r.idx AND s.i > 1 AND s.flow >= 2), len(r.seq)) AS walked FROM flow_reads r",
    "flow_near": f"""SELECT r.*, w.walked, {_unclipped_start} AS us, {_unclipped_end} AS ue, (flag & 16) <> 0 AS reverse, coalesce(tm, '') AS marks FROM flow_reads r JOIN flow_walk w ON r.idx = w.idx""",
    "flow_scores": "SELECT idx, least(sum(CASE WHEN q >= 15 THEN q ELSE 0 END), 16383) - CASE WHEN (any_value(flag) & 512) <> 0 THEN 16384 ELSE 0 END AS fs FROM flow_quals GROUP BY idx",
    "flow_ends": f"""SELECT idx, library, tid AS ref, reverse, {LOCATION}, us, ue, pos, cigar, CASE WHEN reverse THEN ue - walked ELSE us + walked END AS near, CASE WHEN reverse THEN us ELSE ue END AS away, marks,
  CASE WHEN reverse THEN pos + {REF_LEN.format(c='cigar')} - 1 ELSE pos END AS tight, CASE WHEN reverse THEN pos ELSE pos + {REF_LEN.format(c='cigar')} - 1 END AS tight_away, {SCORE} AS plain FROM flow_near""",
    "flow_far": "SELECT e.*, CASE WHEN NOT regexp_matches(marks, 'A') AND regexp_matches(marks, '[QZ]') THEN 0 ELSE away END AS far, CASE WHEN NOT regexp_matches(marks, '[AQ]') AND regexp_matches(marks, '[QZ]') THEN 0 ELSE away END AS far_q FROM flow_ends e",
    "flow_chunks": """SELECT f.idx, library, ref, near AS coord, reverse, far, CASE WHEN far = 0 THEN -1 ELSE fs END AS score, tile, x, y,
  max(CASE WHEN far <> 0 THEN far END) OVER (PARTITION BY library, ref, near, reverse ORDER BY far, coalesce(tile, -1), coalesce(x, -1), coalesce(y, -1), f.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM flow_far f JOIN flow_scores s ON f.idx = s.idx""",
    "flow_sets": "SELECT *, sum(CASE WHEN far <> 0 AND far - before > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY library, ref, coord, reverse ORDER BY far, coalesce(tile, -1), coalesce(x, -1), coalesce(y, -1), idx) AS chunk FROM flow_chunks",
    "flow_best": "SELECT idx, row_number() OVER (PARTITION BY library, ref, coord, reverse, chunk ORDER BY score DESC, far, coalesce(tile, -1), coalesce(x, -1), coalesce(y, -1), idx) AS nth FROM flow_sets",
    "flow_quals": "SELECT idx, flag, first_value(qual) OVER (PARTITION BY idx, run ORDER BY i) AS q FROM flow_runs",
}


def query(select: str, order: str = "coordinate") -> str:
    """The statement with all tables that it names, and that these name, before it; the reads stand in the given order."""
    needed: list[str] = []
    tables = TABLES | {"reads": reads_sql(order).strip()}

    def need(sql: str, own: str = "") -> None:
        for name in tables:
            if name != own and name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                need(tables[name], name)
                needed.append(name)

    need(select)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({tables[n]})" for n in needed) + " " + select
