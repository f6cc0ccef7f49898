"""Edit plans applied to bodies at the places that they name.

A plan names a part of the index (``index``): a block, a line of one, a link or an empty block. It quotes the part's text
as evidence; what it does happens inside that part's interval of the source and nowhere else, so an equal part elsewhere
stays as it is. Edits are intervals with their replacements; they must not overlap and are applied from the last to the
first, so that no edit moves another's place.

Plans of an article are judged one by one: a bad one is left out with its reason and the others are applied. What holds
for all of them together (overlaps, what is to be kept, how much goes, what is left) refuses them all.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from . import index as I
from .batches import bounded
from .edits import deletion
from .evidence import DUPLICATE, LEAST_REASON, MOST_REASON, PROMOTION_TYPES, REMOVAL_TYPES, REPLACEMENT_TYPES, TYPE_NAMES
from .html import to_text, without_empty_blocks, without_links

#: Limits: plans of an article, confidence, characters that go, those that stay, those of a replacement. Fixed values.
MOST_EDITS, LEAST_CONFIDENCE, MOST_REMOVED, LEAST_LEFT, MOST_REPLACEMENT = 5, 0.95, 600, 30, 500
#: Other names of actions. Fixed values.
ACTIONS = {
    "delete_block": "remove_block", "delete_segment": "remove_text_line", "delete_link": "remove_link", "remove_anchor": "remove_link",
    "delete_empty_block": "remove_empty_block", "remove_empty_node": "remove_empty_block", "replace_exact_text": "replace_text", "text_replace": "replace_text",
}
#: What an action may name.
NAMES = {"remove_block": "block", "remove_text_line": "line", "remove_link": "link", "remove_empty_block": "empty"}
NUMBER = re.compile(r"\d+(?:[.,]\d+)?(?:[-:/]\d+)?")

#: Reasons of refusal.
UNKNOWN_ACTION, UNKNOWN_PART, OTHER_EVIDENCE, UNSURE = "unknown action", "unknown block", "evidence differs", "not sure enough"
NOT_LOCAL, KEPT_MISSING, ONLY_LINE = "replacement changes facts or markup", "what is to be kept is missing", "the block has no other line"
TOO_MANY, OVERLAP, TOO_MUCH, TOO_LITTLE, NOTHING = "too many edits", "edits overlap", "too much is removed", "too little is left", "nothing changes"


class Refused(Exception):
    """Why a plan isn't applied."""


class Edit(NamedTuple):
    start: int
    stop: int
    text: str
    removed: int
    part: I.Part
    keep: str | None
    issue: str


def _letters(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


def _flat(text: str | None) -> str:
    return " ".join((text or "").split())


def _issue(plan: dict) -> str:
    name = re.sub(r"[\s-]+", "_", (plan.get("issue_type") or "").strip().lower())
    return TYPE_NAMES.get(name, name)


def _reasoned(plan: dict) -> bool:
    reason = _flat(plan.get("reason"))
    return LEAST_REASON <= len(reason) <= MOST_REASON and "<" not in reason and ">" not in reason


def says_again(removed: str, kept: str) -> bool:
    """Is all that one text says at the beginning of the other?"""
    a, b = _letters(removed), _letters(kept)
    return bool(a) and (a == b or (len(a) >= I.LEAST_PREFIX and b.startswith(a)))


class Body:
    """A body with the index of its parts."""

    def __init__(self, source: str):
        self.source = source
        self.parts = {p.part_id: p for p in I.parts(source) if p.kind in ("block", "line", "link", "empty")}

    def like(self, kind: str) -> list[I.Part]:
        return [p for p in self.parts.values() if p.kind == kind]

    def kept(self, plan: dict, part: I.Part, issue: str) -> str | None:
        """The id of the part that must stay: the one that is named, or for repeated content any that says the same."""
        named = self.parts.get(plan.get("keep_block_id") or "")
        if issue != DUPLICATE:
            if plan.get("keep_block_id") and (named is None or named.part_id == part.part_id):
                raise Refused(KEPT_MISSING)
            return named and named.part_id
        if named is None or named.part_id == part.part_id:
            named = next((p for p in self.like(part.kind) if p.part_id != part.part_id and says_again(part.text, p.text)), None)
        if named is None or not says_again(part.text, named.text):
            raise Refused(KEPT_MISSING)
        return named.part_id

    def edit(self, plan: dict) -> Edit:
        """The edit of a plan; raises Refused."""
        action = (plan["action"] or "").strip().lower()
        duplicate = action == "delete_duplicate"
        name, after, issue = (plan["block_id"] or "").strip().lower(), plan.get("after"), _issue(plan)
        action = ("remove_text_line" if ".s" in name else "remove_block") if duplicate else ACTIONS.get(action, action)
        if action == "replace_text" and (after is None or after.strip().lower() in ("null", "none")):
            action = "remove_text_line" if ".s" in name else "remove_block"
        if action != "replace_text" and action not in NAMES:
            raise Refused(UNKNOWN_ACTION)
        part = self.parts.get(name)
        if part is None or (part.kind != NAMES[action] if action in NAMES else part.kind not in ("block", "line")):
            raise Refused(UNKNOWN_PART)
        evidence, sure = _flat(plan["evidence"]), plan["confidence"]
        whole = evidence == part.text and (bool(evidence) or part.kind == "empty" or (part.kind == "link" and part.images > 0))
        if not whole and not (action == "replace_text" and evidence and part.text.count(evidence) == 1):
            raise Refused(OTHER_EVIDENCE)
        if sure is None or not math.isfinite(sure) or not LEAST_CONFIDENCE <= sure <= 1:
            raise Refused(UNSURE)
        if duplicate and issue != DUPLICATE:
            raise Refused(KEPT_MISSING)
        if action == "replace_text":
            return self.replaced(plan, part, evidence, after, issue)
        if action == "remove_text_line" and len([p for p in self.like("line") if p.parent_id == part.parent_id]) < 2:
            raise Refused(ONLY_LINE)
        keep = self.kept(plan, part, issue) if action in ("remove_block", "remove_text_line") else None
        left = without_links(self.source[part.start : part.stop]) if action == "remove_link" else ""
        return Edit(part.cut_start, part.cut_stop, left, len(part.text), part, keep, issue)

    def replaced(self, plan: dict, part: I.Part, evidence: str, after: str, issue: str) -> Edit:
        """The exact place of a quote inside its part takes another text: less of it, or the same letters and numbers."""
        if not after.strip() or len(after) > MOST_REPLACEMENT or "<" in after or ">" in after:
            raise Refused(NOT_LOCAL)
        text, places = I.decoded(self.source, part.inner_start, part.inner_stop)
        at = text.find(evidence)
        start, stop = places[at][0], places[at + len(evidence) - 1][1]
        if evidence == text and not I.balanced(self.source[start:stop]):
            start, stop = part.inner_start, part.inner_stop
        shape, fragment, known = deletion(evidence, after)
        if shape != "none":
            if issue not in PROMOTION_TYPES + REMOVAL_TYPES or not _reasoned(plan) or not (known or plan.get("verified") is True):
                raise Refused(NOT_LOCAL)
        elif issue not in REPLACEMENT_TYPES or not _reasoned(plan) or _letters(after) != _letters(evidence) or after == evidence or NUMBER.findall(after) != NUMBER.findall(evidence):
            raise Refused(NOT_LOCAL)
        if not I.balanced(self.source[start:stop]):
            raise Refused(NOT_LOCAL)
        return Edit(start, stop, escaped(after), len(fragment), part, None, issue)

    def moved(self, plan: dict) -> dict | None:
        """The plan for the part that its evidence is now found in, where ids have moved on."""
        action, evidence = (plan["action"] or "").strip().lower(), _flat(plan["evidence"])
        if action == "delete_duplicate" or not evidence:
            return None
        if ACTIONS.get(action, action) == "remove_link":
            found = next((p for p in self.like("link") if p.text == evidence), None)
            return found and {**plan, "action": "remove_link", "block_id": found.part_id}
        if found := next((p for p in self.like("block") if p.text == evidence), None):
            line = ACTIONS.get(action, action) == "remove_text_line"
            return {**plan, "action": "remove_block" if line else plan["action"], "block_id": found.part_id}
        found = next((p for p in self.like("line") if p.text == evidence), None)
        return found and {**plan, "action": "remove_text_line", "block_id": found.part_id}


def escaped(text: str) -> str:
    return text.replace("&", "&amp;")


def united(edits: list[Edit]) -> list[Edit]:
    """Edits in order; lines of one block that go side by side are one removal."""
    out: list[Edit] = []
    for e in sorted(edits):
        last = out[-1] if out else None
        lines = last and last.part.kind == e.part.kind == "line" and last.part.parent_id == e.part.parent_id and not last.text and not e.text
        if lines and e.start <= last.stop and (last.start, last.stop) != (e.start, e.stop) and DUPLICATE not in (last.issue, e.issue):
            out[-1] = last._replace(stop=max(last.stop, e.stop), removed=last.removed + e.removed)
        else:
            out.append(e)
    return out


def edited(body: str, plans: list[dict]) -> tuple[str, int, str | None]:
    """(body, applied, error) of an article's plans."""
    return outcome(body, plans)[:3]


def outcome(body: str, plans: list[dict]) -> tuple[str, int, str | None, list[str | None]]:
    """(body, applied, error, the reason of each plan that was left out)."""
    if len(plans) > MOST_EDITS:
        return body, 0, TOO_MANY, [TOO_MANY] * len(plans)
    held, edits, reasons = Body(body), [], []
    for plan in plans:
        try:
            edits.append(held.edit(plan))
            reasons.append(None)
        except Refused as refused:
            reason = str(refused)
            other = held.moved(plan) if len(plans) > 1 and reason in (UNKNOWN_PART, OTHER_EVIDENCE) else None
            try:
                edits.append(held.edit(other)) if other else None
                reasons.append(None if other else reason)
            except Refused:
                reasons.append(reason)
    error = _together(edits)
    if error or not edits:
        error = error or next((r for r in reasons if r), None)
        return body, 0, error, [r or error for r in reasons]
    out = body
    for e in reversed(united(edits)):
        out = out[: e.start] + e.text + out[e.stop :]
    if any(e.part.kind in ("link", "empty") for e in edits):
        out = without_empty_blocks(out)
    error = NOTHING if out == body else TOO_LITTLE if len(to_text(out)) < LEAST_LEFT else None
    return (body, 0, error, [r or error for r in reasons]) if error else (out, len(edits), None, reasons)


def _together(edits: list[Edit]) -> str | None:
    """What speaks against all edits at once."""
    whole = united(edits)
    if any(a.stop > b.start or (a.start, a.stop) == (b.start, b.stop) for a, b in zip(whole, whole[1:])):
        return OVERLAP
    gone = {e.part.part_id for e in edits if not e.text or e.part.kind == "link"}
    if any(e.keep in gone or (e.keep or "").partition(".s")[0] in gone for e in edits if e.keep):
        return KEPT_MISSING
    return TOO_MUCH if sum(e.removed for e in edits) > MOST_REMOVED else None


PLAN = "action string, block_id string, evidence string, after string, confidence double, keep_block_id string"
#: Further fields that plans may have: the issue, why, and whether a verdict says that a deletion loses no fact.
MORE = ("issue_type", "reason", "verified")


def applied_plans(bodies: DataFrame, plans: DataFrame, key: str, body: str = "body_html") -> DataFrame:
    """key, body_after, applied, error, outcomes (seq, reason) for each article with plans: (key, seq, PLAN, MORE).

    ``block_id`` is the id of any part. Plans beyond MOST_EDITS are cut off before they are gathered (one more is enough
    to refuse them), so an article with a million plans costs no more than one with six.
    """
    bounded(bodies.sparkSession)
    fields = [f.split()[0] for f in PLAN.split(", ")] + [f for f in MORE if f in plans.columns]
    first = plans.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("seq"))).filter(F.col("_n") <= MOST_EDITS + 1)
    listed = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_n", "seq", *fields))).alias("plans"))
    joined = bodies.select(key, F.coalesce(body, F.lit("")).alias("body")).join(listed, key)
    told = T.ArrayType(T.StructType([T.StructField("seq", plans.schema["seq"].dataType), T.StructField("reason", T.StringType())]))
    schema = T.StructType([joined.schema[key], T.StructField("body_after", T.StringType()), T.StructField("applied", T.IntegerType()), T.StructField("error", T.StringType()), T.StructField("outcomes", told)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            held = batch.column("plans").to_pylist()
            done = [outcome(b, p) for b, p in zip(batch.column("body").to_pylist(), held, strict=True)]
            reasons = [[{"seq": p["seq"], "reason": r} for p, r in zip(ps, d[3], strict=True)] for ps, d in zip(held, done, strict=True)]
            columns = [pa.array([d[i] for d in done], kinds[i + 1].type) for i in range(3)] + [pa.array(reasons, kinds[4].type)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], schema.names)

    return joined.mapInArrow(apply, schema)
