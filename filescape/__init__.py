"""File-estate analytics on Spark DataFrames."""

from filescape.operators.cleanup import (
    cleanup_plan,
    cleanup_summary,
    dedup_keep_first,
    separate_targets,
    trash_collisions,
    unique_files,
)
from filescape.operators.dedup import (
    duplicate_groups,
    duplicate_members,
    tag_duplicates,
    wasted_size,
    with_content_key,
)
from filescape.operators.grams import gram_candidates, gram_index, grep_indexed, save_grams
from filescape.operators.grep import (
    grep_counts,
    grep_files,
    grep_too_large,
    split_lines,
    text_only,
)
from filescape.operators.index import (
    StoredIndex,
    index_search,
    index_stats,
    merged_sketch,
    name_index,
    name_search,
    posting_blocks,
    save_index,
    search_many,
    sketch_stats,
    token_sketch,
)
from filescape.operators.patterns import (
    name_patterns,
    pattern_buckets,
    refine_patterns,
    split_position,
    varying_positions,
)
from filescape.operators.scope import (
    drop_symlinks,
    ext_filter,
    find_files,
    name_contains,
    parse_ext_list,
    size_range,
    visible_files,
    with_types,
)
from filescape.operators.stats import (
    ext_stats,
    find_totals,
    group_by_ext,
    largest_files,
    scan_summary,
)
from filescape.operators.tree import (
    dir_sizes,
    dirs_of,
    folder_sizes,
    tree_listing,
    tree_order,
    tree_position,
)
from filescape.session import build_session, release
from filescape.sources.catalog import catalog_files, file_catalog
from filescape.sources.content import (
    catalog_grams,
    file_content,
    file_hashes,
    file_lines,
    grep_catalog,
    hash_files,
)
from filescape.sources.manifest import (
    manifest_files,
    manifest_nodes,
    manifest_source,
    read_manifest,
    resolve_folder,
)

__all__ = sorted(name for name, value in globals().items() if callable(value))
