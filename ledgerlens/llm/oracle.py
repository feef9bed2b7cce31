"""SQL, in DuckDB's dialect, of the operators that SQL can express. The others are tested against brute force."""

from __future__ import annotations

from ledgerlens.llm import quality_rules as rules

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = "list_filter(string_split_regex(coalesce({0}, ''), '" + _SPACE + "'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicates(numerator: int, denominator: int) -> str:
    words = _WORDS.format(_LOWER)
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {denominator} * i >= {numerator} * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.node) AS component_id, d.doc_id = min(r.node) AS kept
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _distance(p: str, q: str) -> str:
    part = "(CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END)"
    x, y = f"({p}[k] / list_sum({p}))", f"({q}[k] / list_sum({q}))"
    terms = f"list_transform(range(1, len({p}) + 1), lambda k: ({part.format(x=x, y=y)} + {part.format(x=y, y=x)}) / 2)"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum({terms}))) ELSE 0 END"


def _quantile(source: str, by: str, value: str, share: float) -> str:
    """Per ``by``, the smallest value that at least that share of the rows do not exceed."""
    ranked = f"SELECT {by}, {value}, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM {source}"
    return f"SELECT {by}, {value} AS q FROM ({ranked}) WHERE r = greatest(1, ceil({share} * n)::BIGINT)"


def quality_rules() -> str:
    classes = [f"len(regexp_extract_all(t, {_quoted(c)}))" for c in rules.CLASSES]
    shares = lambda name, total, wanted: f"(SELECT grp, unnest(range(1, len({name}) + 1)) AS k, unnest(list_transform({name}, lambda x: x / {total})) AS v FROM kinds WHERE {wanted} AND {name} IS NOT NULL)"
    by_class, by_word = f"word_chars >= {rules.LEAST_CHARS}", f"n_words >= {rules.LEAST_WORDS}"
    reference = lambda name, total, wanted: f"SELECT grp, list(q ORDER BY k) AS ref FROM ({_quantile(shares(name, total, wanted), 'grp, k', 'v', 0.5)}) GROUP BY grp"
    near = lambda name, wanted, ref: f"CASE WHEN {wanted} AND {name} IS NOT NULL AND {ref} IS NOT NULL THEN {_distance(name, ref)} WHEN {wanted} THEN 0 END"
    columns = f"({near('classes', by_class, 'ra.ref')}) * sqrt(word_chars) AS cz, ({near('listed', by_word, 'rb.ref')}) * sqrt(n_words) AS wz"
    joins = "LEFT JOIN ra ON ra.grp = x.grp LEFT JOIN rb ON rb.grp = x.grp"
    fence = lambda z: f"SELECT lo.grp, CASE WHEN lo.q > 0 THEN hi.q * pow(greatest(hi.q / lo.q, {rules.LEAST_SPREAD}), {rules.FENCE}) END AS most FROM ({_quantile(f'(SELECT grp, {z} FROM scaled WHERE {z} IS NOT NULL)', 'grp', z, 0.25)}) lo JOIN ({_quantile(f'(SELECT grp, {z} FROM scaled WHERE {z} IS NOT NULL)', 'grp', z, 0.75)}) hi ON lo.grp = hi.grp"
    return f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS.format("text")} AS w, {_WORDS.format("lower(text)")} AS lw,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
u AS (SELECT doc_id, lang, unnest(lw) AS word FROM w WHERE len(w) >= 10 AND lang IS NOT NULL),
df AS (SELECT lang, word, count(*) AS n FROM (SELECT doc_id, lang, word FROM u GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
common AS (SELECT lang, list(word ORDER BY n DESC, word) AS words FROM (SELECT * FROM df QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {rules.TOP_WORDS}) GROUP BY lang),
v AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5),
twice AS (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS x(k) GROUP BY doc_id),
c AS (SELECT w.doc_id, w.lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {classes[2]} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words, [{", ".join(classes)}] AS own, list_transform(words, lambda x: len(list_filter(lw, lambda y: y = x))) AS counts
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN common ON common.lang = w.lang),
f AS (SELECT *, list_append(own, word_chars - list_sum(own)) AS classes, CASE WHEN counts IS NOT NULL THEN list_append(counts, n_words - coalesce(list_sum(counts), 0)) END AS all_listed,
             n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
large AS (SELECT lang FROM f WHERE NOT base_failed AND ({by_class} OR {by_word}) AND lang IS NOT NULL GROUP BY lang HAVING count(*) >= {rules.LEAST_DOCUMENTS}),
g AS (SELECT f.*, CASE WHEN large.lang IS NOT NULL THEN '=' || f.lang ELSE '*' END AS grp, CASE WHEN large.lang IS NOT NULL THEN all_listed END AS listed FROM f LEFT JOIN large ON large.lang = f.lang),
kinds AS (SELECT DISTINCT grp, classes, listed, word_chars, n_words FROM g WHERE NOT base_failed AND ({by_class} OR {by_word})),
ra AS ({reference("classes", "word_chars", by_class)}), rb AS ({reference("listed", "n_words", by_word)}),
scaled AS (SELECT x.grp, {columns} FROM kinds x {joins}),
fa AS ({fence("cz")}), fb AS ({fence("wz")}),
d AS (SELECT x.*, {columns} FROM g x {joins})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(cz <= fa.most, TRUE) AND coalesce(wz <= fb.most, TRUE) AS kept
FROM d LEFT JOIN fa ON fa.grp = d.grp LEFT JOIN fb ON fb.grp = d.grp"""


def _crc32(text: str) -> str:
    """The checksum by half bytes, the lower half of each byte first."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    digits = f"string_split(hex(encode({text})), '')"
    halves = f"list_transform(range(0, 2 * strlen({text})), lambda i: (strpos('0123456789ABCDEF', {digits}[i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END]) - 1)::BIGINT)"
    step = f"lambda c, v: xor(list_extract({table}::BIGINT[], (xor(c, v) & 15) + 1), c >> 4)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), {step}), 4294967295)"


def hilbert_shards(shards: int = 16, bits: int = 6) -> str:
    cells, n = 1 << bits, 3
    rank = lambda c: f"(SELECT {c}, (dense_rank() OVER (ORDER BY {c}) - 1) * {cells} // (SELECT count(DISTINCT {c}) FROM documents) AS cell FROM (SELECT DISTINCT {c} FROM documents WHERE {c} IS NOT NULL))"
    text = _crc32("t")
    out = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size FROM documents),
h AS (SELECT t, string_split(hex(encode(t)), '') AS h FROM (SELECT DISTINCT t FROM d)),
z AS (SELECT t, {text.replace("string_split(hex(encode(t)), '')", "h")} AS crc FROM h),
s AS (SELECT size, row_number() OVER (ORDER BY size) AS r, count(*) OVER () AS n FROM d),
e AS (SELECT DISTINCT size AS edge FROM s WHERE r IN (SELECT ceil(k * n / {cells}.0)::BIGINT FROM range(1, {cells}) x(k))),
c0 AS (SELECT d.doc_id, d.size, z.crc, coalesce(a.cell, 0) AS x0, coalesce(b.cell, 0) AS x1, (SELECT count(*) FROM e WHERE edge <= d.size) AS x2
       FROM d JOIN z USING (t) LEFT JOIN {rank("lang")} a ON a.lang = d.lang LEFT JOIN {rank("source")} b ON b.source = d.source)"""
    k = 0
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            low, hit = q - 1, f"x{i} & {q} <> 0"
            swap = f"(xor(x0, x{i}) & {low})"
            first = f"CASE WHEN {hit} THEN xor(x0, {low}) ELSE xor(x0, {swap}) END AS x0"
            rest = [first if j == 0 else f"CASE WHEN {hit} THEN x{j} ELSE xor(x{j}, {swap}) END AS x{j}" if j == i else f"x{j}" for j in range(n)]
            out += f",\nc{k + 1} AS (SELECT doc_id, size, crc, {', '.join(rest)} FROM c{k})"
            k += 1
    flip = "0"
    for q in (1 << b for b in range(bits - 1, -1, -1)):
        flip = f"xor({flip}, CASE WHEN g2 & {q} <> 0 THEN {q - 1} ELSE 0 END)"
    index = " + ".join(f"(CASE WHEN xor(g{i}, f) & {1 << b} <> 0 THEN {1 << (b * n + n - 1 - i)} ELSE 0 END)" for b in range(bits) for i in range(n))
    return (
        out
        + f""",
g AS (SELECT doc_id, size, crc, x0 AS g0, xor(x0, x1) AS g1, xor(xor(x0, x1), x2) AS g2 FROM c{k}),
f AS (SELECT *, {flip} AS f FROM g),
i AS (SELECT doc_id, size, crc, ({index})::BIGINT AS curve FROM f),
p AS (SELECT *, row_number() OVER (ORDER BY curve, crc, doc_id NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM i),
o AS (SELECT *, pos * {shards} // n AS shard FROM p)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, pos - (shard * n + {shards - 1}) // {shards} AS slot, NULL::INTEGER AS grown_shard, curve FROM o"""
    )


SQL = {"op4_quality_rules": quality_rules(), "op8_hilbert_shards": hilbert_shards(), "op10_neardup": near_duplicates(85, 100)}
