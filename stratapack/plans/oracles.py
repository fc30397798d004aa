"""The queries in SQL, written apart from the DataFrame code."""

from __future__ import annotations

from ..functions.gear import GEAR
from ..functions.scalars import PRECOMPRESSED

_PACKED = ", ".join(f"'{x}'" for group in PRECOMPRESSED.values() for x in group)
_GEAR = "[" + ", ".join(map(str, GEAR)) + "]::BIGINT[]"

#: Document files by path: file_id, rel_path, x (hex of the content), size.
FILES = """
d AS (SELECT doc_id, coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS rel_path,
             hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents),
files AS (SELECT *, row_number() OVER (ORDER BY rel_path) - 1 AS file_id FROM d)"""

#: Chunks by the gear hash, byte by byte.
CHUNKS = f"""
hashed AS (SELECT file_id, x, size, list_prepend({{'h': 0::BIGINT, 'l': 0, 'p': 0, 'cuts': []::INT[]}},
    list_transform(regexp_extract_all(x, '..'), lambda b: {{'h': ({_GEAR})[('0x' || b)::INT + 1], 'l': 0, 'p': 0, 'cuts': []::INT[]}})) AS s FROM files),
scanned AS (SELECT file_id, x, size, list_reduce(s, lambda a, b: CASE
    WHEN a.l + 1 >= 1024 OR (a.l + 1 >= 64 AND ((((a.h * 2) & 4294967295) | (a.h >> 31)) + b.h) & 255 = 0)
    THEN {{'h': 0::BIGINT, 'l': 0, 'p': a.p + 1, 'cuts': list_append(a.cuts, a.p + 1)}}
    ELSE {{'h': ((((a.h * 2) & 4294967295) | (a.h >> 31)) + b.h) & 4294967295, 'l': a.l + 1, 'p': a.p + 1, 'cuts': a.cuts}} END) AS r FROM hashed),
ends AS (SELECT file_id, x, CASE WHEN r.l > 0 THEN list_append(r.cuts, r.p) ELSE r.cuts END AS e FROM scanned),
cut AS (SELECT file_id, x, e, unnest(range(1, len(e) + 1)) AS i FROM ends),
occ AS MATERIALIZED (SELECT file_id, (i - 1)::INT AS chunk_ord, CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END::BIGINT AS start, e[i]::BIGINT AS stop,
    (e[i] - CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END)::INT AS len,
    sha256(unhex(substr(x, 2 * CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END + 1, 2 * (e[i] - CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END)))) AS hash FROM cut)"""

#: Chunks where bytes come in blocks of 4096: with each block, the bytes of the unfinished chunk are hashed again.
GRID = f"""
bytes AS MATERIALIZED (SELECT file_id, x, size, list_transform(regexp_extract_all(x, '..'), lambda b: {{'h': ({_GEAR})[('0x' || b)::INT + 1], 'l': 0, 'p': 0, 'cuts': []::INT[]}}) AS s FROM files WHERE size > 0),
grid AS (SELECT file_id, 0 AS k, {{'h': 0::BIGINT, 'l': 0, 'p': 0, 'cuts': []::INT[]}} AS r FROM bytes
  UNION ALL
  SELECT g.file_id, k + 1, list_reduce(list_prepend({{'h': g.r.h, 'l': 0, 'p': g.r.p - g.r.l, 'cuts': g.r.cuts}}, b.s[g.r.p - g.r.l + 1 : least(b.size, (k + 1) * 4096)]), lambda a, b: CASE
    WHEN a.l + 1 >= 1024 OR (a.l + 1 >= 64 AND ((((a.h * 2) & 4294967295) | (a.h >> 31)) + b.h) & 255 = 0)
    THEN {{'h': 0::BIGINT, 'l': 0, 'p': a.p + 1, 'cuts': list_append(a.cuts, a.p + 1)}}
    ELSE {{'h': ((((a.h * 2) & 4294967295) | (a.h >> 31)) + b.h) & 4294967295, 'l': a.l + 1, 'p': a.p + 1, 'cuts': a.cuts}} END)
  FROM grid g JOIN bytes b ON g.file_id = b.file_id WHERE k * 4096 < b.size),
done AS (SELECT g.file_id, x, CASE WHEN r.l > 0 THEN list_append(r.cuts, r.p) ELSE r.cuts END AS e FROM grid g JOIN bytes b ON g.file_id = b.file_id WHERE k * 4096 >= b.size),
pieces AS (SELECT file_id, x, e[i] AS stop, i, CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END AS start FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM done))"""

DICT = """
first AS (SELECT hash, min(file_id * 10000000 + chunk_ord) AS seen, max(len) AS raw_size FROM occ GROUP BY hash),
dict AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seen) - 1 AS chunk_idx, hash, raw_size,
         coalesce(sum(raw_size) OVER (ORDER BY seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spool_offset FROM first)"""

#: Greedy blocks: from each block's first offset to the first chunk that takes it to 64 KiB.
BLOCKS = """
starts AS (SELECT 0::BIGINT AS a, 0::BIGINT AS block_id WHERE EXISTS (SELECT 1 FROM dict)
  UNION ALL
  SELECT (SELECT min(spool_offset + raw_size) FROM dict WHERE spool_offset + raw_size >= s.a + 65536)::BIGINT, s.block_id + 1 FROM starts s
  WHERE (SELECT max(spool_offset) FROM dict) >= (SELECT min(spool_offset + raw_size) FROM dict WHERE spool_offset + raw_size >= s.a + 65536)),
placed AS (SELECT d.*, s.block_id, d.spool_offset - s.a AS off_in_block FROM dict d ASOF JOIN starts s ON d.spool_offset >= s.a),
blocks AS (SELECT block_id, sum(raw_size)::BIGINT AS raw_size, count(*) AS chunks FROM placed GROUP BY block_id)"""

#: What the container adds up to in store mode.
TOTALS = """
f AS (SELECT count(*) AS file_count, sum(size)::BIGINT AS total_raw, sum(octet_length(encode(rel_path)) + 26)::BIGINT AS table_bytes FROM files),
c AS (SELECT count(*) AS chunk_count, sum(raw_size)::BIGINT AS unique_bytes FROM dict),
o AS (SELECT count(*) AS refs FROM occ), b AS (SELECT count(*) AS block_count FROM blocks),
totals AS (SELECT *, 32 + table_bytes + 4 * refs AS data_start, unique_bytes AS comp_bytes,
                  32 + table_bytes + 4 * refs + unique_bytes + 12 * chunk_count + 17 * block_count + 28 AS total_comp FROM f, c, o, b)"""

_RENAMED = """
CASE doc_id % 4 WHEN 0 THEN 'new/' || rel_path WHEN 2 THEN 'same.txt' ELSE rel_path END"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


_ALL = (FILES, CHUNKS, DICT, BLOCKS, TOTALS)
_EXT = "lower(regexp_extract({0}, '\\.([A-Za-z0-9]+)$', 1))"


def _human(n: str) -> str:
    units = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]
    out = f"WHEN {n} < 1024 THEN {n} || ' B'"
    for i in range(1, 7):
        u = f"(1::HUGEINT << {10 * i})"
        top = f"{n} < (1::HUGEINT << {10 * i + 10})" if i < 6 else "true"
        hundredths = f"(({n}::HUGEINT * 200 + {u}) // (2 * {u}))"
        out += f" WHEN {top} THEN CASE WHEN {n}::HUGEINT // {u} >= 100 THEN ((2 * {n}::HUGEINT + {u}) // (2 * {u})) || ' {units[i]}' ELSE ({hundredths} // 100) || '.' || lpad(({hundredths} % 100)::VARCHAR, 2, '0') || ' {units[i]}' END"
    return f"CASE {out} END"


def _crc_table() -> str:
    """The table of CRC-32 by its rule: eight halvings, each with the polynomial if a bit falls out."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ 0xEDB88320 * (x & 1)
        out.append(x)
    return f"[{', '.join(map(str, out))}]::BIGINT[]"


def _crc(hexed: str) -> str:
    """CRC-32 of bytes in hex, folded byte by byte."""
    each = f"list_transform(regexp_extract_all({hexed}, '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda a, b: xor(a >> 8, ({_crc_table()})[(xor(a, b) & 255) + 1])), 4294967295)"


ORACLES: dict[str, str] = {
    "crc32_files": _with(FILES) + f" SELECT doc_id AS file_id, {_crc('x')} AS crc FROM files",
    "zip_stored": f"""
        WITH p AS (SELECT 'pages/' || page_id || '.html' AS rel_path, hex(encode(coalesce(html, ''))) AS x FROM pages),
        s AS (SELECT rel_path, (len(x) // 2)::BIGINT AS size, {_crc('x')} AS crc FROM p)
        SELECT rel_path, size, size AS comp_size, crc, row_number() OVER (ORDER BY rel_path) - 1 AS ord,
          coalesce(sum(30 + octet_length(encode(rel_path)) + size) OVER (ORDER BY rel_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS header_offset FROM s""",
    "codec_roundtrip": "SELECT page_id AS file_id, octet_length(encode(coalesce(html, '')))::BIGINT AS size, sha256(encode(coalesce(html, ''))) AS sha256 FROM pages",
    "extract_roundtrip_fast": "SELECT 'pages/' || page_id || '.html' AS rel_path, sha256(encode(coalesce(html, ''))) AS sha256, octet_length(encode(coalesce(html, '')))::BIGINT AS raw_size FROM pages",
    "extracted_files": _with(FILES) + " SELECT rel_path, size, sha256(unhex(x)) AS sha256, 1600000000000 + doc_id * 1000 AS mtime_ms FROM files",
    "container_marks": _with(*_ALL) + """ SELECT 2 AS version, 'store' AS mode, 1 AS flags, file_count, chunk_count, total_raw, total_comp, data_start + comp_bytes AS chunk_index_off,
        data_start + comp_bytes + 12 * chunk_count AS block_index_off, block_count FROM totals""",
    "container_entries": _with(FILES, CHUNKS, DICT) + """, m AS (SELECT file_id, count(*)::INT AS n, string_agg(chunk_idx::VARCHAR, ',' ORDER BY chunk_ord) AS chunk_map FROM occ JOIN dict USING (hash) GROUP BY file_id)
        SELECT f.file_id AS file_ord, rel_path, 420 AS mode, 1600000000000 + doc_id * 1000 AS mtime_ms, size AS raw_size, coalesce(n, 0)::INT AS chunk_count, coalesce(chunk_map, '') AS chunk_map
        FROM files f LEFT JOIN m ON f.file_id = m.file_id""",
    "container_chunks": _with(*_ALL) + """, places AS (SELECT block_id, raw_size AS block_size, data_start + coalesce(sum(raw_size) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS data_offset FROM blocks, totals)
        SELECT chunk_idx, p.block_id, off_in_block, raw_size::BIGINT AS raw_size, data_offset, block_size, true AS stored FROM placed p JOIN places ON p.block_id = places.block_id""",
    "dedup_exact_docs": """
        WITH f AS (SELECT sha256(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents),
        p AS (SELECT h, count(*) AS n, max(size) AS size FROM f GROUP BY h),
        t AS (SELECT sum(n)::BIGINT AS files, count(*) AS distinct_files, sum(n * size)::BIGINT AS total_bytes, sum(size)::BIGINT AS unique_bytes FROM p)
        SELECT *, total_bytes::DOUBLE / unique_bytes AS factor, (1 - unique_bytes::DOUBLE / total_bytes) * 100 AS saved_percent FROM t""",
    "top_duplicate_docs": """
        WITH f AS (SELECT doc_id, sha256(encode(coalesce(text, ''))) AS hash, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents)
        SELECT hash, count(*) AS copies, max(size) AS size, min(doc_id) AS first_file FROM f GROUP BY hash HAVING count(*) > 1 ORDER BY copies DESC, size DESC, hash LIMIT 20""",
    "copies_per_source": """
        WITH f AS (SELECT doc_id, coalesce(source, 'none') AS source, encode(coalesce(text, '')) AS b FROM documents),
        g AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY sha256(b)) AS copy FROM f)
        SELECT source, count(*) AS files, sum(copy::BIGINT)::BIGINT AS copies, coalesce(sum(octet_length(b)) FILTER (copy), 0)::BIGINT AS copied_bytes FROM g GROUP BY source""",
    "ext_of_pages": f"""SELECT page_id, {_EXT.format("url")} AS ext, {_EXT.format("url")} IN ({_PACKED}) AS precompressed, regexp_matches(url, '\\.drk$', 'i') AS is_archive FROM pages""",
    "precompressed_share": f"""
        WITH f AS (SELECT octet_length(encode(coalesce(html, '')))::BIGINT AS size, lower(['mp4', 'HTML', 'zip', 'txt', 'PDF', ''][page_id % 6 + 1]) AS ext FROM pages),
        t AS (SELECT coalesce(sum(size) FILTER (ext IN ({_PACKED})), 0)::BIGINT AS packed_bytes, coalesce(sum(size), 0)::BIGINT AS total_bytes FROM f)
        SELECT *, CASE WHEN total_bytes > 0 THEN packed_bytes::DOUBLE / total_bytes ELSE 0 END AS share FROM t""",
    "compress_note": """
        SELECT p_partkey, CASE WHEN (p_size % 12 - 4) / 2.0 >= 3 THEN NULL
          WHEN p_partkey % 5 >= 3 THEN 'already compressed: media and archives hardly shrink further, and were stored as they are'
          WHEN (p_size % 12 - 4) / 2.0 <= 0.5 THEN 'near maximum density: the data looks random, encrypted or packed'
          ELSE 'low compressibility: little redundant data to remove' END AS note FROM part""",
    "humanize_sizes": f"""
        WITH v AS (SELECT o_orderkey, ((o_orderkey * 131 + o_custkey)::HUGEINT << ((o_orderkey % 5) * 9)::INT)::BIGINT AS n FROM orders)
        SELECT o_orderkey, n, {_human("n")} AS shown, {_human("n")} || '/s' AS rate FROM v""",
    "elapsed_fmt": """
        WITH v AS (SELECT o_orderkey, (o_orderkey * 7919) % (1000 * (10 ** (o_orderkey % 4))::BIGINT) AS ms FROM orders)
        SELECT o_orderkey, ms, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN ((ms + 50) // 100 // 10) || '.' || ((ms + 50) // 100 % 10) || 's'
          ELSE (ms // 60000) || 'm ' || ((ms % 60000 + 500) // 1000) || 's' END AS shown FROM v""",
    "mode_map": """
        WITH v AS (SELECT p_partkey, p_size, p_size % 10 + 1 AS r FROM part),
        m AS (SELECT *, CASE WHEN r <= 1 THEN 'store' WHEN r <= 3 THEN 'fast' WHEN r <= 6 THEN 'max' ELSE 'ultra' END AS mode FROM v)
        SELECT p_partkey, mode, list_position(['ultra', 'max', 'fast', 'store'], mode)::INT - 1 AS mode_id, coalesce((['ultra', 'max', 'fast', 'store'])[p_size % 6 + 1], 'ultra') AS of_id,
          CASE mode WHEN 'store' THEN 0 WHEN 'fast' THEN 6 ELSE 9 END AS level, greatest(0, least(9, p_size - 20)) AS deflate, least(p_size - 20, 5) AS rar FROM m""",
    "names": """
        SELECT c_custkey, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '.DRK' END || (['.drk', '.zip', '.7z', '.rar', '.drk'])[c_custkey % 5 + 1] AS output,
          'in/' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '' END AS stem, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END || '_extracted' AS folder,
          c_custkey % 2 = 1 AS is_archive FROM customer""",
    "progress": _with(FILES) + """, r AS (SELECT file_id AS ord, rel_path, sum(size) OVER (ORDER BY file_id)::BIGINT AS done, sum(size) OVER ()::BIGINT AS total FROM files),
        p AS (SELECT *, floor(done::DOUBLE / total * 100) AS pct FROM r), b AS (SELECT *, floor(pct / 100 * 28 + 0.5)::INT AS n FROM p)
        SELECT ord, rel_path, done, '[' || repeat('█', n) || repeat('░', 28 - n) || '] ' || lpad(pct::INT::VARCHAR, 3, ' ') || '%' AS bar FROM b""",
    "permissions": """SELECT o_orderkey, ((o_custkey * 37 + 32768) & 511)::INT AS mode, round(o_totalprice)::BIGINT AS mtime_ms, substr((o_custkey % 1200)::VARCHAR, greatest(1, length((o_custkey % 1200)::VARCHAR) - 2))::INT AS parsed FROM orders""",
    "cdc_chunks": _with(FILES, CHUNKS) + " SELECT file_id, chunk_ord, start, stop, len, hash FROM occ",
    "cdc_grid": _with(FILES, GRID) + " SELECT file_id, (i - 1)::INT AS chunk_ord, start::BIGINT AS start, stop::BIGINT AS stop, sha256(unhex(substr(x, 2 * start + 1, 2 * (stop - start)))) AS hash FROM pieces",
    "cdc_stats": _with(FILES, CHUNKS) + """, p AS (SELECT hash, count(*) AS n, max(len) AS len FROM occ GROUP BY hash)
        SELECT sum(n)::BIGINT AS refs, count(*) AS unique_chunks, sum(n * len)::BIGINT AS raw_bytes, sum(len)::BIGINT AS unique_bytes, min(len) AS shortest, max(len) AS longest FROM p""",
    "chunk_dictionary": _with(FILES, CHUNKS, DICT) + " SELECT chunk_idx, hash, raw_size, spool_offset FROM dict",
    "file_chunk_maps": _with(FILES, CHUNKS, DICT) + " SELECT file_id, count(*)::INT AS chunk_count, string_agg(chunk_idx::VARCHAR, ',' ORDER BY chunk_ord) AS chunk_map FROM occ JOIN dict USING (hash) GROUP BY file_id",
    "solid_blocks": _with(FILES, CHUNKS, DICT, BLOCKS) + " SELECT block_id, raw_size, chunks FROM blocks",
    "chunk_index": _with(FILES, CHUNKS, DICT, BLOCKS) + " SELECT chunk_idx, block_id, off_in_block, raw_size FROM placed",
    "block_index_store": _with(*_ALL) + """ SELECT block_id, data_start + coalesce(sum(raw_size) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS data_offset,
        raw_size AS comp_size, raw_size, true AS stored FROM blocks, totals""",
    "layout_size_store": _with(*_ALL) + " SELECT file_count, chunk_count, block_count, refs, table_bytes, data_start, unique_bytes, comp_bytes, total_comp FROM totals",
    "archive_info_store": _with(*_ALL) + " SELECT file_count, total_raw, total_comp, total_raw::DOUBLE / total_comp AS factor, (1 - total_comp::DOUBLE / total_raw) * 100 AS saved_percent FROM totals",
    "list_entries": _with(FILES, CHUNKS) + """ SELECT f.file_id AS file_ord, rel_path, 420 AS mode, 1600000000000 + doc_id * 1000 AS mtime_ms, size AS raw_size, coalesce(n, 0)::INT AS chunk_count
        FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM occ GROUP BY file_id) o ON f.file_id = o.file_id""",
    "extract_roundtrip": _with(FILES) + " SELECT rel_path, sha256(unhex(x)) AS sha256, size, 1600000000000 + doc_id * 1000 AS mtime_ms FROM files",
    "selective_extract": _with(FILES) + " SELECT rel_path, sha256(unhex(x)) AS sha256 FROM files WHERE contains(rel_path, '/src3/')",
    "self_exclude": _with(FILES) + " SELECT count(*) AS files, sum(size)::BIGINT AS bytes FROM files WHERE rel_path <> 'en/src1/1.txt'",
    "rename_entries": _with(FILES) + f" SELECT file_id AS file_ord, {_RENAMED} AS rel_path FROM files",
    "rename_report": _with(FILES) + """, o AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'renamed' WHEN 1 THEN 'ignored' WHEN 2 THEN CASE WHEN count(*) OVER (PARTITION BY doc_id % 4) > 1 THEN 'collision' ELSE 'renamed' END END AS outcome FROM files UNION ALL SELECT 'missing')
        SELECT outcome, count(*) AS n FROM o WHERE outcome IS NOT NULL GROUP BY outcome""",
    "rename_layout": _with(*_ALL) + f""", s AS (SELECT sum(octet_length(encode({_RENAMED})) - octet_length(encode(rel_path)))::BIGINT AS delta FROM files)
        SELECT block_id, delta + data_start + coalesce(sum(raw_size) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS data_offset FROM blocks, totals, s""",
    "canonical_order": _with(FILES) + " SELECT file_id AS ord, rel_path FROM files",
    "path_distinct": """
        SELECT coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/all.txt' AS rel_path, min(doc_id) AS file_id, count(*) - 1 AS dropped FROM documents GROUP BY coalesce(lang, 'none'), coalesce(source, 'none')""",
    "page_window": "SELECT 'pages/' || page_id || '.html' AS rel_path, octet_length(encode(coalesce(html, '')))::BIGINT AS size FROM pages ORDER BY rel_path LIMIT 20 OFFSET 40",
    "folder_listing": """
        WITH r AS (SELECT DISTINCT coalesce(lang, 'none') AS name, true AS is_dir FROM documents UNION ALL SELECT page_id || '.html', false FROM pages)
        SELECT row_number() OVER (ORDER BY is_dir DESC, name) - 1 AS ord, name, is_dir FROM r""",
    "conversation_files": """
        WITH c AS (SELECT conv_id, encode(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS b FROM conversations GROUP BY conv_id)
        SELECT conv_id AS file_id, octet_length(b)::BIGINT AS size, sha256(b) AS sha256 FROM c""",
    "incremental_chunks": _with(FILES, CHUNKS) + " SELECT hash, max(len) AS len FROM occ GROUP BY hash",
}
