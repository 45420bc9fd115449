"""Traffic source labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from webtally.functions import fixed
from webtally.functions.urls import join_text


def first_match(rules: list[tuple[str, Column]], default: str) -> Column:
    """Label of the first rule that holds."""
    last_first = reversed(rules)
    return reduce(lambda rest, rule: F.when(rule[1], F.lit(rule[0])).otherwise(rest), last_first, F.lit(default))


def source_medium(source: Column, medium: Column, gclid: Column) -> Column:
    """``source / medium``, replaced by the paid label when a click id is present; NULL if a part is missing."""
    return F.when(gclid.isNotNull(), F.lit(fixed.PAID_CLICK_SOURCE)).otherwise(
        join_text(source, medium, separator=" / ")
    )


def traffic_category(source: Column) -> Column:
    return first_match(
        [
            ("Search", source.isin(fixed.SEARCH_SOURCES)),
            ("Social", source.isin(fixed.SOCIAL_SOURCES)),
            ("Direct", source == "direct"),
        ],
        "Other",
    )


def channel_grouping(source: Column, medium: Column, campaign: Column, gclid: Column) -> Column:
    """Marketing channel of a session: paid variants of a site family come before its organic variant."""
    site, way = F.lower(source), F.lower(medium)
    families = {name: site.rlike(pattern) for name, pattern in fixed.SITES.items()}
    paid = {name: family & way.rlike(fixed.PAID_MEDIUMS) for name, family in families.items()}
    paid["Search"] = gclid.isNotNull() | paid["Search"]
    organic = {
        "Shopping": families["Shopping"],
        "Social": families["Social"] | way.isin(fixed.SOCIAL_MEDIUMS),
        "Video": families["Video"] | way.contains("video"),
        "Search": families["Search"] | (way == "organic"),
    }
    rules = [("Direct", source.isNull() | medium.isNull()), ("Cross-network", F.lower(campaign).contains("cross-network"))]
    rules += [(f"Paid {name}", paid[name]) for name in fixed.PAID_ORDER]
    rules += [("Display", way.isin(fixed.DISPLAY_MEDIUMS))]
    rules += [(f"Organic {name}", organic[name]) for name in fixed.ORGANIC_ORDER]
    rules += [("Email", site.rlike(fixed.EMAIL_NAMES) | way.rlike(fixed.EMAIL_NAMES))]
    rules += [(channel, way == name) for name, channel in fixed.MEDIUM_CHANNELS.items()]
    rules += [("Push Notifications", way.contains("push") | way.rlike(fixed.PUSH_MEDIUMS))]
    return first_match(rules, "Unassigned")
