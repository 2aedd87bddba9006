"""Rows of a registry as sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the sentence of each kind of node and edge; {sanctioned} is told as SANCTIONED says
SENTENCES = {
    "Corridor": "{canonical_name} (Corridor) has throughput_mbpd of {throughput_mbpd} and choke_severity {choke_severity}, located at latitude {location_lat}, longitude {location_lon}.",
    "Supplier": "{canonical_name} (Supplier) is based in country {country}, has daily_export_mbpd of {daily_export_mbpd}, and {sanctioned}.",
    "Refinery": "{canonical_name} (Refinery) has capacity_mbpd of {capacity_mbpd} and inventory_days of {inventory_days}, located at latitude {location_lat}, longitude {location_lon}.",
    "CrudeGrade": "{canonical_name} (CrudeGrade) has api_gravity {api_gravity} and sulfur_pct {sulfur_pct}, origin {origin}.",
    "Port": "{canonical_name} (Port) has draft_m of {draft_m} and congestion {congestion}, located at latitude {location_lat}, longitude {location_lon}.",
    "SPRCavern": "{canonical_name} (SPRCavern) has capacity_mmt of {capacity_mmt} and current_fill_mmt of {current_fill_mmt}, location {location}.",
    "Authority": "{canonical_name} (Authority) has jurisdiction {jurisdiction}.",
    "GeoEvent": "{canonical_name} (GeoEvent): actor {actor}, action {action}, severity {severity}, event_time {event_time}.",
    "ProductionField": "{canonical_name} (ProductionField) in {country} produces {output_mbpd} mbpd with {spare_mbpd} mbpd spare capacity. Crude grade context from connected Supplier nodes via PRODUCES_AT edges.",
    "DistributionHub": "{canonical_name} (DistributionHub) in {region} has demand {demand_mbpd} mbpd with primary product mix: {primary_product_mix}.",
    "EXPORTS_VIA": "{src_name} (Supplier) EXPORTS_VIA {dst_name} (Corridor) at volume_mbpd {volume_mbpd}.",
    "FEEDS": "{src_name} (Corridor) FEEDS {dst_name} (Port) with throughput_share_pct {throughput_share_pct}.",
    "SUPPLIES": "{src_name} (Port) SUPPLIES {dst_name} (Refinery) with throughput_share_pct {throughput_share_pct}.",
    "CONFIGURED_FOR": "{src_name} (Refinery) is CONFIGURED_FOR {dst_name} (CrudeGrade) with compatibility {compatibility} and yield_pct {yield_pct}.",
    "BYPASS_ROUTE": "{src_name} (Supplier) has a BYPASS_ROUTE via {dst_name} (Port) with cost_premium {cost_premium} and added_days {added_days}.",
    "PRODUCES_AT": "{src_name} (Supplier) PRODUCES_AT {dst_name} (ProductionField) with output {output_mbpd} mbpd, grade {crude_grade}.",
    "DISTRIBUTES_TO": "{src_name} (Refinery) DISTRIBUTES_TO {dst_name} (DistributionHub) flow {flow_mbpd} mbpd of {product_type}.",
}
SANCTIONED = {True: "is sanctioned", False: "is not sanctioned"}


def prose(kind: str) -> Column:
    """The sentence of a kind from the columns it names; a missing value is told as an empty one."""
    parts = []
    for text, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", SENTENCES[kind]):
        if text:
            parts.append(F.lit(text))
        if name == "sanctioned":
            parts.append(F.when(F.lower(F.col(name).cast("string")) == "true", SANCTIONED[True]).otherwise(SANCTIONED[False]))
        elif name:
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
    return F.concat(*parts)
