"""Schemas of the archive's relations. None is ever inferred."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


FILES = _struct("path string, rel_path string, size bigint, mode int, mtime_ms double, content binary")
CHUNK_REFS = _struct("file_id bigint, chunk_ord int, start bigint, end bigint, len int, hash string, chunk_idx bigint")
CHUNKS = _struct("chunk_idx bigint, hash string, raw_size int, spool_offset bigint, block_id bigint, off_in_block bigint")
CHUNK_INDEX = _struct("chunk_idx bigint, block_id bigint, off_in_block bigint, raw_size bigint")
BLOCKS = _struct("block_id bigint, data_offset bigint, comp_size bigint, raw_size bigint, stored boolean, payload binary")
ENTRIES = _struct("file_ord bigint, rel_path string, mode int, mtime_ms bigint, raw_size bigint, chunk_count int, chunk_map array<bigint>")
HEADER = _struct("version int, mode string, flags int, file_count bigint, chunk_count bigint, total_raw bigint, total_comp bigint")
FOOTER = _struct("chunk_index_off bigint, block_index_off bigint, block_count bigint")
