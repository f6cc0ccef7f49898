"""Explicit schemas of the content-operations tables."""

from __future__ import annotations

FEED_ITEM = (
    "source string, source_url string, translate_title string, translate_body string, archive_id string, "
    "user_name string, username string, dqd_litpic string, channels string"
)
FEED_PAGE = f"code int, msg string, data struct<items: array<struct<{FEED_ITEM.replace(' string', ': string')}>>, total: bigint, has_more: boolean>"
QUALITY = (
    "pass boolean, needs_review boolean, manual_review boolean, decision string, reason string, regional_sensitive boolean, "
    "repair_plan_error string, issues map<string, array<string>>, league_guard struct<tab_id: bigint, tab_name: string, guard_tab_id: bigint, guard_tab_name: string, "
    "configured_publish_mode: int, effective_publish_mode: int, reassigned_tab_id: bigint, reassigned_tab_active: boolean, "
    "actual_competition: string, verdict: struct<belongs: boolean, confidence: double, reason: string>>"
)
#: The issue lists of a quality record. Fixed values.
ISSUES = ("title_problems", "dirty_content", "completeness_problems", "channel_problems", "semantic_problems")
#: All states of an article. Fixed values.
STATUSES = (
    "RECEIVED", "QUALITY_CHECKING", "NEEDS_REVIEW", "READY_TO_PUBLISH", "PUBLISHING", "DRAFT_CONFIRMING", "DRAFT_CREATED", "PUBLISHED",
    "PUBLISH_FAILED", "REJECTED", "ALREADY_PUBLISHED", "MAPPING_BLOCKED", "SOURCE_DUPLICATE", "TITLE_DUPLICATE", "ABANDONED", "ERROR",
)
