"""Statistics of operators, inspection of plans, and the query catalogue."""

from graniteq.plans.inspect import plan_nodes
from graniteq.plans.stats import Blocked, DedupStats, JoinStats, OpStats, dedup_stats, hash_join_stats, merge_join_stats, observed_count, sort_pass_stats, sort_run_counts

__all__ = ["Blocked", "DedupStats", "JoinStats", "OpStats", "dedup_stats", "hash_join_stats", "merge_join_stats", "observed_count", "plan_nodes", "sort_pass_stats", "sort_run_counts"]
