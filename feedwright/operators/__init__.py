"""Data jobs: plain DataFrame in, plain DataFrame out."""

from .attributes import catalog_values, json_number, json_scope_extract, json_unassigned
from .audit import duplicate_groups, mixed_state_keys, multi_value_keys
from .codes import missing_primary, upc_cascade, upc_listing
from .feed import (
    attribute_population,
    cause_matrix,
    delta_feed,
    drop_counts,
    owned_value,
    qa_round_stats,
    rate_tier_checks,
    rows_with_attribute,
    silent_drop_audit,
    write_policy,
)
from .inventory import (
    ChannelProfile,
    alias_resolved_sum,
    available_to_sell,
    collect_measures,
    for_listed,
    kit_floor_min,
    kit_over_product,
    kit_quantities_by_store,
    kit_store_grid,
    listed_variants,
    open_order_qty,
)
from .keys import distinct_keys, join_summary, join_unique, left_many
from .latest import first_seen_date, latest_record, undetermined_pick
from .locations import (
    change_log_match,
    expected_locations,
    location_reconcile,
    match_locations,
    multi_location_skus,
    quantity_reconcile,
    stocked_skus,
    stored_locations,
)
from .lookups import LookUp, drop_steps, drop_trace, trace_look_ups
from .orders import (
    committed_sales_union,
    event_totals,
    id_from_uri,
    import_trace,
    open_lines,
    order_trace,
    recent_top_n,
    shipment_leak,
    shipped_not_logged,
    store_lookup,
    unshipped_not_logged,
)
from .population import (
    active_kits,
    catalog_rows,
    coverage_gap,
    cross_store_difference,
    eligible_population,
    exclude,
    membership_flags,
    only_in,
    presence_report,
    sellable_items,
)
from .reconcile import Pair, channel_parity, flag_pairs, reconcile, structure_parity
from .replay import feed_interference, feed_writes, image_state, merge_sent, state_delta
from .rollup import catalog_price_matrix, flag_rollup, location_unpivot, store_pivot, store_string
from .rounds import discrepancy_states, round_diff
from .traffic import (
    calendar_totals,
    local_time_counts,
    monthly_counts,
    period_cross_system,
    threshold_days,
    total_counts,
    with_location,
    yearly_counts,
)

__all__ = [name for name in dir() if not name.startswith("_")]
