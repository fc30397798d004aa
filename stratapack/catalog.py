"""Registered queries of the deduplicating archiver and the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries as Q
from .plans.oracles import ORACLES

_ALL = (
    Q.dedup_exact_docs, Q.top_duplicate_docs, Q.copies_per_source, Q.ext_of_pages, Q.precompressed_share, Q.compress_note, Q.humanize_sizes, Q.elapsed_fmt, Q.mode_map, Q.names, Q.progress, Q.permissions,
    Q.cdc_chunks, Q.cdc_stats, Q.chunk_dictionary, Q.file_chunk_maps, Q.solid_blocks, Q.chunk_index, Q.block_index_store, Q.layout_size_store, Q.archive_info_store, Q.list_entries,
    Q.extract_roundtrip, Q.selective_extract, Q.self_exclude, Q.rename_entries, Q.rename_report, Q.rename_layout, Q.canonical_order, Q.path_distinct, Q.page_window, Q.folder_listing,
    Q.conversation_files, Q.codec_ratio, Q.crc32_files, Q.zip_manifest, Q.incremental_chunks,
    Q.cdc_grid, Q.zip_stored, Q.codec_roundtrip, Q.extract_roundtrip_fast, Q.container_marks, Q.container_entries, Q.container_chunks, Q.extracted_files,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

__all__ = ["ORACLES", "QUERIES"]
