"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from minekit.llm import fingerprints, mixing, near_dup, packing, pii, quality, token_counts, token_files, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_near_duplicates": near_dup.op4_near_duplicates,
    "op6_token_files": token_files.op6_token_files,
    "op5_pii": pii.op5_pii,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR_DUPLICATES = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
  lists AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS s FROM w),
  sets AS MATERIALIZED (SELECT doc_id, unnest(s) AS s FROM lists),
  pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS MATERIALIZED (SELECT a, b FROM pairs JOIN lists x ON x.doc_id = a JOIN lists y ON y.doc_id = b WHERE 100 * k >= 80 * (len(x.s) + len(y.s) - k)),
  both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT doc_id, doc_id AS seen FROM lists UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
  least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1)
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM lists JOIN least USING (doc_id)"""

_P = mixing.PRIME
_HASH = "CAST('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 8) AS BIGINT)"
_OTHER = "((k.point + {n} - x) % {n})"
_STEP = f"(x * x % {_P} + x * {{by}} + {{plus}}) % {_P}"
_A = f"[{_STEP.format(by=69621, plus=7919)} FOR x IN [(({{key}}) % {_P} * 48271 + r * 7919 + 11) % {_P} FOR r IN range(1, {mixing.ROUNDS + 1})]]"
_AB = f"[{{{{'a': x, 'b': {_STEP.format(by=16807, plus=104729)}}}}} FOR x IN {_A}]"
_KEYS = f"[{{{{'point': (p.a * {_P} + p.b) % {{n}}, 'salt': {_STEP.format(by=48271, plus=11).replace('x', 'p.b')}}}}} FOR p IN {_AB}]"
_T = f"((greatest(x, {_OTHER}) % {_P} + (greatest(x, {_OTHER}) >> 31) * 7919 + k.salt) % {_P})"
_PERMUTED = f"list_reduce({{keys}}, lambda x, k: CASE WHEN {_T} * {_T} % {_P} % 2 = 1 THEN {_OTHER} ELSE x END, CAST({{x}} AS BIGINT))"
_MIXING = f"""WITH sized AS MATERIALIZED (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS s,
    CAST(coalesce(len({_WORDS.format(text='text')}), 0) AS BIGINT) AS size FROM documents),
  by_source AS (SELECT s, source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1, 2),
  ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM by_source),
  weighed AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS most FROM ranked),
  levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM weighed WINDOW before AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  reached AS (SELECT coalesce((SELECT level FROM levels WHERE level <= most / weight ORDER BY most / weight, rank LIMIT 1), 0) AS level),
  sources AS MATERIALIZED (SELECT s, rank, source_size, least(most, weight * (SELECT level FROM reached)) AS target FROM weighed),
  planned AS (SELECT s, rank, CAST(ceil(source_size / {mixing.BLOCK}) AS BIGINT) AS n, CAST(round(target * ceil(source_size / {mixing.BLOCK}) / source_size) AS BIGINT) AS slots FROM sources WHERE source_size > 0),
  sums AS MATERIALIZED (SELECT *, CAST(sum(slots) OVER (ORDER BY rank) - slots AS BIGINT) AS first, CAST(sum(slots) OVER () AS BIGINT) AS total FROM planned),
  epochs AS (SELECT *, unnest(range((slots + n - 1) // n)) AS epoch FROM sums),
  keyed AS MATERIALIZED (SELECT *, {_KEYS.format(key=f"{_HASH.format(x='s')} + epoch * 1000003", n='n')} AS keys, {_KEYS.format(key=f'{mixing.ALL_SLOTS}::BIGINT', n='total')} AS all_keys FROM epochs),
  unfolded AS (SELECT s, n, first, total, epoch, keys, all_keys, unnest(range(least(n, slots - epoch * n))) AS i FROM keyed),
  slots AS (SELECT s, {_PERMUTED.format(keys='keys', x='i', n='n')} AS block, {_PERMUTED.format(keys='all_keys', x='first + epoch * n + i', n='total')} // {mixing.SHARD} AS shard FROM unfolded),
  times AS MATERIALIZED (SELECT s, block, count(*) AS times, min(shard) AS shard FROM slots GROUP BY 1, 2),
  chunks AS (SELECT greatest(1, (count(*) + {mixing.CHUNK - 1}) // {mixing.CHUNK}) AS k FROM sized),
  placed AS MATERIALIZED (SELECT *, CAST(sum(size) OVER (PARTITION BY s ORDER BY coalesce({_HASH.format(x='doc_id')}, 0) % (SELECT k FROM chunks), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
    FROM sized WHERE size > 0),
  cut AS (SELECT doc_id, s, size, start, unnest(range(start // {mixing.BLOCK}, (start + size - 1) // {mixing.BLOCK} + 1)) AS block FROM placed),
  found AS (SELECT doc_id, c.s, size, start, sum((least(start + size, (c.block + 1) * {mixing.BLOCK}) - greatest(start, c.block * {mixing.BLOCK})) * times) AS taken, min(shard) AS first_shard
    FROM cut c JOIN times t ON t.s = c.s AND t.block = c.block GROUP BY 1, 2, 3, 4),
  everyone AS (SELECT doc_id, s, size, start FROM placed UNION ALL SELECT doc_id, s, size, 0 FROM sized WHERE size = 0)
  SELECT e.doc_id, e.size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, coalesce(first_shard, -1) AS first_shard FROM everyone e JOIN sources USING (s)
  LEFT JOIN found f ON f.s = e.s AND f.start = e.start AND f.size = e.size AND e.size > 0"""

ORACLES: dict[str, str] = {
    "op2_mixing": _MIXING,
    "op4_near_duplicates": _NEAR_DUPLICATES,
}
