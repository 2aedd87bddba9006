"""Columns for pages and feed items: tags, labels, front matter, what belongs into a feed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what a page's front matter must have
REQUIRED_FIELDS = ("entity_id", "entity_type", "risk_score", "risk_band", "factors", "last_updated", "valid_at")
REQUIRED_FACTORS = ("ais", "gdelt", "price", "sanctions")
REPLAY = "REPLAY:"


def tags(kind: Column, band: Column, app: str = "tideline") -> Column:
    """Two tags for graph colouring: ``<app>/<type>`` and ``risk/<band>``, in lower case and without spaces or slashes."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown"))), "[ /]", "")
    return F.array(F.concat(F.lit(f"{app}/"), plain), _risk(band))


def _risk(band: Column) -> Column:
    return F.concat(F.lit("risk/"), F.lower(F.coalesce(F.nullif(band, F.lit("")), F.lit("calm"))))


def retagged(old: Column, band: Column) -> Column:
    """The tags with their risk tag replaced; others stay in order."""
    kept = F.filter(F.coalesce(old, F.array().cast("array<string>")), lambda t: ~F.startswith(t, F.lit("risk/")))
    return F.array_append(kept, _risk(band))


def first_label(labels: Column) -> Column:
    """The first label that says more than that this is an entity."""
    return F.coalesce(F.get(F.filter(labels, lambda x: x != "Entity"), F.lit(0)), F.lit("Entity"))


def is_replay(raw_ref: Column) -> Column:
    return F.coalesce(F.startswith(raw_ref, F.lit(REPLAY)), F.lit(False))


def in_feed(source: Column, content: Column, headline: Column) -> Column:
    """Whether an item belongs into the feed of news: no own texts, no assessments, no raw event records."""
    head = F.lower(headline)
    own = F.coalesce(source.isin("text", "synthesis"), F.lit(False))
    return ~(own | F.contains(F.lower(content), F.lit("risk level is assessed")) | F.contains(head, F.lit("goldstein=")) | F.startswith(head, F.lit("gdelt:")))


def front_matter_errors(content: Column) -> Column:
    """What keeps a page from being accepted, in order; an empty array if nothing does."""
    front = F.regexp_extract(content, r"(?s)\A---(.*?)---", 1)
    fields = F.regexp_extract_all(front, F.lit(r"(?m)^([A-Za-z_]+):"), F.lit(1))
    inline = F.trim(F.regexp_extract(front, r"(?m)^factors:([^\n]*)$", 1))
    below = F.regexp_extract(front, r"(?m)^factors:[ \t]*\n((?:[ \t]+[^\n]*\n?)*)", 1)
    factors = F.regexp_extract_all(below, F.lit(r"(?m)^[ \t]+([a-z_]+):"), F.lit(1))
    missing = [F.when(~F.array_contains(fields, f), F.lit(f"Missing required frontmatter field: '{f}'")) for f in REQUIRED_FIELDS]
    has = F.array_contains(fields, "factors")
    mapping = (inline == "") & (below != "")
    missing += [F.when(has & mapping & ~F.array_contains(factors, f), F.lit(f"Missing factor sub-field: 'factors.{f}'")) for f in REQUIRED_FACTORS]
    missing.append(F.when(has & ~mapping, F.lit("'factors' must be a dict with keys: ais, gdelt, price, sanctions")))
    # a second mark three characters in or later ends the block
    closed = F.instr(F.substring(content, 4, 1 << 30), "---") > 0
    return F.when(~F.coalesce(F.startswith(content, F.lit("---")), F.lit(False)), F.array(F.lit("Missing YAML frontmatter block"))).when(~closed, F.array(F.lit("Malformed frontmatter YAML"))).otherwise(F.filter(F.array(*missing), lambda x: x.isNotNull()))
