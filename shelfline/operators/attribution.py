"""Customer journeys and revenue attribution.

A journey is the set of touches a customer had in the look-back window before an order. A touch
counts for every order in whose window it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import carry, split_row_number
from ..functions.scalar import at_least, cases, count_if, lookup, money, ratio, since

# Touch channels, decay rate, position weights and class labels.
ADS, EMAIL = "facebook", "email"
DECAY_PER_HOUR = 0.1
SHORT_JOURNEY_WEIGHTS = {1: [1.0], 2: [0.3, 0.7], 3: [0.2, 0.3, 0.5]}
FIRST_LAST_MIDDLE = (0.4, 0.4, 0.2)
CHANNEL_VOLATILITY = {"organic": 1.0, "facebook": 1.3, "email": 2.0, "google_ads": 1.2}
ADS_WINDOWS, EMAIL_WINDOWS = (1, 7, 28), (1, 3, 7)

LOOKBACK_DAYS = 7
CHUNK = 1000


def journey_touches(conversions: DataFrame, touches: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Every order with each touch of its customer in the `days` before it; a touch counts for all such orders.

    Both sides meet on the customer and a time slot of `days` days (an order looks into its own slot and the one
    before), so a busy customer's history is spread over slots and a hot slot can be split by the join."""
    slot = lambda ts: F.floor(F.datediff(F.to_date(ts), F.lit("1970-01-01")) / days)
    orders = conversions.select(
        "order_id", "order_ts", "revenue", "date", "customer_email", "product_id", "customer_id",
        F.explode(F.array(slot("order_ts"), slot("order_ts") - 1)).alias("slot"),
    )
    t = touches.select("customer_id", "channel", "campaign_id", "touch_ts", "touch_id", slot("touch_ts").alias("slot"))
    inside = (F.col("touch_ts") <= F.col("order_ts")) & (F.col("order_ts") <= F.col("touch_ts") + F.expr(f"INTERVAL {days} DAYS"))
    return orders.join(t, ["customer_id", "slot"]).filter(inside).select(
        "order_id", "order_ts", "revenue", "date", "customer_email", "product_id", "customer_id", "channel", "campaign_id", "touch_ts", "touch_id"
    )


def journey_summary(jt: DataFrame) -> DataFrame:
    """One row per order: first and last channel, counts, duration, last campaign per channel."""
    when = F.struct("touch_ts", "touch_id")

    def latest(channel: str) -> Column:
        return F.max_by("campaign_id", F.when(F.col("channel") == channel, when))

    return jt.groupBy("order_id").agg(
        F.min_by("channel", when).alias("first_touch_channel"),
        F.max_by("channel", when).alias("last_touch_channel"),
        F.min("touch_ts").alias("first_touch_ts"),
        F.max("touch_ts").alias("last_touch_ts"),
        F.count(F.lit(1)).alias("touchpoint_count"),
        count_if(F.col("channel") == ADS).alias("ads_touches"),
        count_if(F.col("channel") == EMAIL).alias("email_touches"),
        latest(ADS).alias("ads_campaign_id"),
        latest(EMAIL).alias("email_campaign_id"),
    )


def attribution(conversions: DataFrame, touches: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Attribution table: one row per order, linear credit per channel by touch count."""
    s = journey_summary(journey_touches(conversions, touches, days))
    d = conversions.join(s, "order_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("touchpoint_count", "ads_touches", "email_touches")}
    )
    return d.select(
        "order_id",
        "customer_id",
        "customer_email",
        "date",
        "order_ts",
        "product_id",
        F.col("revenue").alias("total_attributed_revenue"),
        "first_touch_channel",
        "last_touch_channel",
        "first_touch_ts",
        "last_touch_ts",
        "touchpoint_count",
        "ads_touches",
        "email_touches",
        "ads_campaign_id",
        "email_campaign_id",
        F.expr("timestampdiff(HOUR, first_touch_ts, last_touch_ts)").alias("journey_duration_hours"),
        money(linear_share("ads_touches")).alias("ads_attributed_revenue"),
        money(linear_share("email_touches")).alias("email_attributed_revenue"),
        ratio(F.col("ads_touches") + F.col("email_touches"), "touchpoint_count").alias("attribution_weight"),
    )


def linear_share(touches: str) -> Column:
    return F.col("revenue") * ratio(touches, "touchpoint_count", 0.0)


def sequences(jt: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Ordered touch sequence per order as JSON, in chunks so that one journey never is one huge cell."""
    pos = split_row_number(jt, ["order_id"], "touch_ts", "touch_id", "position")
    item = F.struct("position", "channel", "campaign_id", F.date_format("touch_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    return (
        pos.withColumn("chunk", F.floor((F.col("position") - 1) / chunk).cast("bigint"))
        .groupBy("order_id", "chunk")
        .agg(F.sort_array(F.collect_list(item)).alias("s"))
        .select(
            "order_id",
            "chunk",
            F.size("s").cast("bigint").alias("touches"),
            F.to_json(F.transform("s", lambda x: F.struct(x["channel"].alias("channel"), x["campaign_id"].alias("campaign_id"), x["timestamp"].alias("timestamp")))).alias(
                "touchpoint_sequence"
            ),
        )
    )


def expand_sequences(seq: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Touch positions 1..n back out of the JSON sequences."""
    parsed = F.from_json("touchpoint_sequence", "array<struct<channel:string,campaign_id:string,timestamp:string>>")
    e = seq.select("order_id", "chunk", F.posexplode(parsed).alias("p", "x"))
    return e.select(
        "order_id",
        (F.col("chunk") * chunk + F.col("p") + 1).alias("position"),
        F.col("x.channel").alias("channel"),
        F.col("x.campaign_id").alias("campaign_id"),
    )


def decay_weight(p: Column, n: Column) -> Column:
    """Fixed weights up to three touches, then powers of two divided by their geometric sum."""
    rules = [
        ((n == size) & (p == i + 1), w) for size, weights in SHORT_JOURNEY_WEIGHTS.items() for i, w in enumerate(weights)
    ]
    return cases(rules, F.pow(F.lit(2.0), p - n) / (2 - F.pow(F.lit(2.0), 1 - n)))


def numbered(jt: DataFrame) -> DataFrame:
    """Touches with their position and the length of their journey."""
    return split_row_number(jt, ["order_id"], "touch_ts", "touch_id", "position", total="n")


def time_decay_by_campaign(jt: DataFrame) -> DataFrame:
    w = numbered(jt).withColumn("w", decay_weight(F.col("position"), F.col("n")))
    return w.groupBy("channel", "campaign_id").agg(
        F.countDistinct("customer_email").alias("attributed_customers"),
        F.sum(F.col("revenue") * F.col("w")).alias("weighted_attributed_revenue"),
        F.avg("w").alias("avg_attribution_weight"),
        F.sum("revenue").alias("total_revenue_influenced"),
    )


def hours_to_order() -> Column:
    return F.expr("timestampdiff(HOUR, touch_ts, order_ts)")


def recency_weights(jt: DataFrame, rate: float = DECAY_PER_HOUR) -> DataFrame:
    """Exponential recency weight per order and channel, normalised to one per order.

    Touches fold to (order, channel) before the window, so a window partition holds a handful of rows.
    """
    g = jt.groupBy("order_id", "channel", "revenue").agg(F.sum(F.exp(-rate * hours_to_order())).alias("w"))
    share = ratio("w", F.sum("w").over(Window.partitionBy("order_id")), 0.0)
    return g.select("order_id", "channel", share.alias("attribution_weight"), (F.col("revenue") * share).alias("channel_attributed_revenue"))


def position_based(jt: DataFrame) -> DataFrame:
    """40 / 20 / 40 by position; one or two touches share everything equally."""
    first, last, middle = FIRST_LAST_MIDDLE
    p, n = F.col("position"), F.col("n")
    w = F.when(n <= 2, 1.0 / n).when(p == 1, first).when(p == n, last).otherwise(middle / (n - 2))
    return numbered(jt).groupBy("order_id", "channel").agg(F.sum(w).alias("weight"), F.sum(F.col("revenue") * w).alias("attributed_revenue"))


def linear_credit(attr: DataFrame) -> DataFrame:
    return attr.select("order_id", "total_attributed_revenue", "ads_attributed_revenue", "email_attributed_revenue", "touchpoint_count")


def window_credit(conversions: DataFrame, touches: DataFrame) -> DataFrame:
    """Order revenue credited per channel when its last touch falls in a 1, 7, 28 (ads) or 1, 3, 7 (e-mail) day window.

    Only the last touch before the order decides, so an as-of lookup replaces the interval join.
    """
    conv = conversions.select(
        "customer_id", F.col("order_ts").alias("ts"), F.col("order_id").alias("tie"), "order_id", "product_id", "date", "revenue",
        F.lit(None).cast("timestamp_ntz").alias("ads_ts"), F.lit(None).cast("timestamp_ntz").alias("email_ts"),
    )
    t = touches.filter(F.col("channel").isin(ADS, EMAIL)).select(
        "customer_id", F.col("touch_ts").alias("ts"), F.col("touch_id").alias("tie"), F.lit(None).cast("bigint").alias("order_id"),
        F.lit(None).cast("bigint").alias("product_id"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("revenue"),
        F.when(F.col("channel") == ADS, F.col("touch_ts")).alias("ads_ts"), F.when(F.col("channel") == EMAIL, F.col("touch_ts")).alias("email_ts"),
    )
    d = carry(conv.unionByName(t), "customer_id", "ts", "tie", ["ads_ts", "email_ts"]).filter(F.col("order_id").isNotNull())

    def credit(touch: str, days: int) -> Column:
        return F.when(F.col("ts") <= F.col(touch) + F.expr(f"INTERVAL {days} DAYS"), F.col("revenue")).otherwise(0.0)

    return d.select(
        "order_id",
        "product_id",
        "date",
        "revenue",
        *[credit("ads_ts", w).alias(f"ads_{w}d_revenue") for w in ADS_WINDOWS],
        *[credit("email_ts", w).alias(f"email_{w}d_revenue") for w in EMAIL_WINDOWS],
    )


#: Length of the piece of text by which a URL finds the campaign keys that it may contain.
ANCHOR = 6


def _pieces(text: str, size: Column | int) -> Column:
    """Different pieces of a text that are `size` long; none of a shorter text."""
    n = F.length(text) - size + 1
    return F.array_distinct(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i <= n), lambda i: F.substr(F.col(text), i, F.lit(size) if isinstance(size, int) else size)))


def anchored(keys: DataFrame) -> DataFrame:
    """Keys with their anchor: of the pieces of ANCHOR characters the one that fewest keys have; short keys as a whole."""
    long = F.length("key") >= ANCHOR
    pieces = keys.filter(long).select("key").distinct().withColumn("anchor", F.explode(_pieces("key", ANCHOR)))
    common = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    rarest = pieces.join(common, "anchor").groupBy("key").agg(F.min(F.struct("n", "anchor")).alias("x")).select("key", "x.anchor")
    return keys.filter(long).join(rarest, "key").unionByName(keys.filter(~long).withColumn("anchor", F.col("key")))


def campaign_url_matches(orders: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Orders whose landing URL contains a campaign name, or its cleaned form after `utm_campaign=`.

    Containment becomes an equi-join: each distinct URL is cut into its pieces of ANCHOR characters (one per position at
    most) and joined with the keys on their rarest piece, their anchor; then the whole key is looked for in the URL. Keys
    shorter than that join on pieces of their own length (the few such lengths come from a one-row subquery). The
    matches go back to the orders on the URL.
    """
    name = F.lower("campaign_name")
    keys = campaigns.select(
        "campaign_id",
        F.explode(F.array(name, F.concat(F.lit("utm_campaign="), F.regexp_replace(name, "[^a-z0-9_-]+", "")))).alias("key"),
    ).distinct()
    short = keys.filter(F.length("key") < ANCHOR).agg(F.collect_set(F.length("key")).alias("l")).scalar()
    visits = orders.filter(F.length("landing_site") > 1).select("order_id", "landing_site")
    urls = visits.select("landing_site").distinct().select("landing_site", F.lower("landing_site").alias("url"), short.alias("short"))
    small = F.array_distinct(F.flatten(F.transform("short", lambda n: _pieces("url", n))))
    parts = urls.select("landing_site", "url", F.explode(F.concat(_pieces("url", ANCHOR), small)).alias("anchor"))
    found = parts.join(anchored(keys), "anchor").filter(F.contains("url", "key"))
    matches = found.select("landing_site", "campaign_id").distinct()
    return visits.join(matches, "landing_site").select("order_id", "campaign_id", F.lit(ADS).alias("channel"))


def journey_view(orders: DataFrame, attr: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with their attribution and the customer's profile."""
    a = attr.select(
        "order_id", "first_touch_channel", "last_touch_channel", "ads_attributed_revenue", "email_attributed_revenue", "touchpoint_count", "journey_duration_hours"
    )
    p = customers.select(
        F.col("email").alias("customer_email"), F.col("total_orders").alias("lifetime_orders"), F.col("total_spent").alias("lifetime_value"),
        "customer_segment", "lifecycle_stage", "email_engagement_score",
    )
    credited = (F.col("ads_attributed_revenue") > 0) | (F.col("email_attributed_revenue") > 0)
    return (
        orders.join(a, "order_id", "left")
        .join(p, "customer_email", "left")
        .withColumn("order_type", F.when(credited, "attributed").otherwise("organic"))
    )


def either_key_join(attr: DataFrame, mail: DataFrame) -> DataFrame:
    """Attribution rows with the mail of the day that matches by campaign or by flow.

    `mail` has one row per date and campaign or flow. Two equi-joins, their union without
    repeats, then a left join back: no nested loop, and unmatched rows stay.
    """
    keyed = mail.withColumn("mail_key", F.concat_ws("|", "date", "campaign_id", "flow_id"))
    by_campaign = attr.join(keyed.drop("flow_id"), (attr["mail_campaign_id"] == keyed["campaign_id"]) & (attr["date"] == keyed["date"]))
    by_flow = attr.join(keyed.drop("campaign_id"), (attr["mail_flow_id"] == keyed["flow_id"]) & (attr["date"] == keyed["date"]))
    cols = ["order_id", "mail_key", "open_rate", "click_rate"]
    hits = by_campaign.select(cols).unionByName(by_flow.select(cols)).dropDuplicates(["order_id", "mail_key"])
    return attr.join(hits, "order_id", "left")


def clv(attr: DataFrame) -> DataFrame:
    return attr.groupBy("customer_email").agg(
        F.sum("total_attributed_revenue").alias("total_clv"),
        F.count("order_id").alias("total_orders"),
        F.min("date").alias("first_attribution_date"),
        F.max("date").alias("last_attribution_date"),
    )


def clv_by_channel_pair(attr: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Journeys fold to (customer, channel pair) before meeting the customer's value."""
    rows = attr.filter(since("date", as_of, days)).groupBy("customer_email", "first_touch_channel", "last_touch_channel").agg(F.count(F.lit(1)).alias("n"))
    j = rows.join(clv(attr), "customer_email")
    n = F.sum("n")
    return j.groupBy("first_touch_channel", "last_touch_channel").agg(
        n.alias("customer_count"),
        ratio(F.sum(F.col("total_clv") * F.col("n")), n).alias("avg_customer_clv"),
        F.sum(F.col("total_clv") * F.col("n")).alias("total_channel_clv"),
        ratio(F.sum(F.col("total_orders") * F.col("n")), n).alias("avg_orders_per_customer"),
    )


def with_customer_segments(attr: DataFrame) -> DataFrame:
    """Order-count and value segment of the customer next to each journey."""
    m = attr.groupBy("customer_email").agg(
        F.count("order_id").alias("total_orders"),
        F.sum("total_attributed_revenue").alias("lifetime_value"),
        F.avg("total_attributed_revenue").alias("avg_order_value"),
    )
    n = F.col("total_orders")
    seg = m.select(
        "customer_email",
        "lifetime_value",
        "avg_order_value",
        cases([(n == 1, "new_customer"), (n.between(2, 5), "returning_customer"), (n > 5, "loyal_customer")]).alias("customer_segment"),
        at_least("lifetime_value", [(500, "high_value"), (200, "medium_value")], "low_value").alias("value_segment"),
    )
    return attr.select("order_id", "customer_email", "total_attributed_revenue").join(seg, "customer_email", "left")


def daily_touch_revenue(attr: DataFrame) -> DataFrame:
    """First- and last-touch revenue per day, product and channel pair."""

    def rev(side: str, channel: str) -> Column:
        return F.sum(F.when(F.col(f"{side}_touch_channel") == channel, F.col("total_attributed_revenue")).otherwise(0.0))

    return attr.groupBy(F.col("date").alias("attribution_date"), "product_id", "first_touch_channel", "last_touch_channel").agg(
        F.sum("total_attributed_revenue").alias("total_attributed_revenue"),
        F.count("order_id").alias("attributed_orders"),
        rev("first", ADS).alias("ads_first_touch_revenue"),
        rev("last", ADS).alias("ads_last_touch_revenue"),
        rev("first", EMAIL).alias("email_first_touch_revenue"),
        rev("last", EMAIL).alias("email_last_touch_revenue"),
        F.avg("touchpoint_count").alias("avg_touchpoints"),
        F.countDistinct("customer_email").alias("unique_customers"),
    )


def channel_pairs(attr: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    a, b = F.col("first_touch_channel"), F.col("last_touch_channel")
    g = (
        attr.filter(since("date", as_of, days) & (F.col("total_attributed_revenue") > 0))
        .groupBy("first_touch_channel", "last_touch_channel")
        .agg(
            F.count(F.lit(1)).alias("conversion_count"),
            F.sum("total_attributed_revenue").alias("rev"),
            F.avg("journey_duration_hours").alias("avg_journey_hours"),
            F.avg("touchpoint_count").alias("avg_touchpoints"),
        )
    )
    kind = cases([(a == b, "single_channel"), ((a == ADS) & (b == EMAIL), "facebook_to_email"), ((a == EMAIL) & (b == ADS), "email_to_facebook")], "multi_channel")
    return g.select(
        "first_touch_channel",
        "last_touch_channel",
        "conversion_count",
        money("rev").alias("total_revenue"),
        money(ratio("rev", "conversion_count")).alias("revenue_per_conversion"),
        "avg_journey_hours",
        "avg_touchpoints",
        kind.alias("journey_type"),
    )


def journey_patterns(jt: DataFrame, as_of: str, days: int = 90, min_count: int = 5, top: int = 20) -> DataFrame:
    """The highest-earning journey paths seen at least `min_count` times.

    Paths are compared by a position-aware 128-bit fingerprint, folded before the shuffle, so no
    journey is gathered just to be counted; only the winning paths are spelled out, from one
    example order each, whose touches are picked out again before any of them is sorted.
    """
    recent = jt.filter(since("date", as_of, days)).select("order_id", "revenue", "channel", "touch_ts", "touch_id")
    pos = split_row_number(recent, ["order_id"], "touch_ts", "touch_id", "position")
    h1, h2 = F.xxhash64("position", "channel"), F.xxhash64("channel", F.lit("path"), "position")
    prints = pos.groupBy("order_id", "revenue").agg(
        F.bit_xor(h1).alias("h1"), F.bit_xor(h2).alias("h2"), F.count(F.lit(1)).alias("n"), F.min("touch_ts").alias("first_ts"), F.max("touch_ts").alias("last_ts")
    )
    hours = F.expr("timestampdiff(HOUR, first_ts, last_ts)")
    best = (
        prints.groupBy("h1", "h2", "n")
        .agg(
            F.count(F.lit(1)).alias("journey_frequency"),
            F.avg("revenue").alias("avg_revenue"),
            F.avg("n").alias("avg_touchpoints"),
            F.avg(hours).alias("avg_duration_hours"),
            F.avg(F.when(hours > 0, ratio("n", hours))).alias("avg_velocity"),
            F.sum("revenue").alias("total_revenue"),
            F.min("order_id").alias("order_id"),
        )
        .filter(F.col("journey_frequency") >= min_count)
        .orderBy(F.desc("total_revenue"), "order_id")
        .limit(top)
    )
    touches = recent.join(best, "order_id").groupBy("order_id", *[c for c in best.columns if c != "order_id"])
    path = F.sort_array(F.collect_list(F.struct("touch_ts", "touch_id", "channel")))
    spelled = touches.agg(F.array_join(F.transform(path, lambda x: x["channel"]), " -> ").alias("journey_pattern"))
    return spelled.drop("order_id", "h1", "h2", "n")


def model_comparison(attr: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """First-touch, last-touch and linear revenue side by side: one pass, then three rows."""

    def rev(side: str, channel: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(f"{side}_touch_channel") == channel, F.col("total_attributed_revenue"))), F.lit(0.0))

    t = attr.filter(since("date", as_of, days)).agg(
        rev("first", ADS).alias("fa"), rev("first", EMAIL).alias("fe"), rev("last", ADS).alias("la"), rev("last", EMAIL).alias("le"),
        F.sum("ads_attributed_revenue").alias("na"), F.sum("email_attributed_revenue").alias("ne"),
    )
    models = F.array(
        *[
            F.struct(F.lit(n).alias("attribution_model"), F.col(a).alias("ads_attributed_revenue"), F.col(e).alias("email_attributed_revenue"), (F.col(a) + F.col(e)).alias("total_attributed_revenue"))
            for n, a, e in [("first_touch", "fa", "fe"), ("last_touch", "la", "le"), ("linear", "na", "ne")]
        ]
    )
    return t.select(F.inline(models))


def demand_rate(attr: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Attribution events and revenue per product and channel pair; daily means averaged over days."""
    daily = (
        attr.filter(since("date", as_of, days) & (F.col("touchpoint_count") > 0))
        .groupBy("date", "product_id", "first_touch_channel", "last_touch_channel")
        .agg(F.sum("total_attributed_revenue").alias("r"), F.count(F.lit(1)).alias("n"), F.avg("journey_duration_hours").alias("h"))
    )
    return daily.groupBy("product_id", "first_touch_channel", "last_touch_channel").agg(
        F.sum("r").alias("total_attributed_revenue"),
        F.sum("n").alias("total_attribution_events"),
        F.avg("h").alias("avg_customer_journey_hours"),
        (F.sum("n") / F.lit(float(days))).alias("daily_attribution_rate"),
        ratio(F.sum("r"), F.sum("n")).alias("revenue_per_attribution"),
    )


def budget_share(attr: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    g = (
        attr.filter(since("date", as_of, days))
        .groupBy("first_touch_channel")
        .agg(
            F.sum("total_attributed_revenue").alias("attributed_revenue"),
            F.countDistinct("customer_email").alias("attributed_customers"),
            F.avg("journey_duration_hours").alias("avg_journey_hours"),
        )
    )
    total = g.agg(F.sum("attributed_revenue")).scalar()
    return g.select(
        "*",
        money(ratio("attributed_revenue", "attributed_customers")).alias("revenue_per_customer"),
        money(ratio("attributed_revenue", total) * 100).alias("recommended_budget_percentage"),
    )


def campaign_totals(attr: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    return (
        attr.filter(since("date", as_of, days))
        .groupBy("ads_campaign_id", "email_campaign_id", F.col("date").alias("attribution_date"))
        .agg(
            F.sum("ads_attributed_revenue").alias("ads_total_attributed"),
            F.sum("email_attributed_revenue").alias("email_total_attributed"),
            F.count("order_id").alias("attributed_orders"),
        )
    )


def ad_credit(attr: DataFrame) -> DataFrame:
    """Campaign revenue at 0.4 for a first or last ad touch, 0.2 when the ad only assisted."""
    w = cases([(F.col("first_touch_channel") == ADS, 0.4), (F.col("last_touch_channel") == ADS, 0.4)], 0.2)
    return (
        attr.filter(F.col("ads_campaign_id").isNotNull())
        .groupBy(F.col("ads_campaign_id").alias("campaign_id"))
        .agg(F.sum(F.col("total_attributed_revenue") * w).alias("attributed_revenue"), F.sum("total_attributed_revenue").alias("total_revenue"))
    )


def last_campaigns(jt: DataFrame) -> DataFrame:
    """Most recent campaign per order and channel, as columns."""
    s = journey_summary(jt)
    return s.select("order_id", "ads_campaign_id", "email_campaign_id")


def weekly_velocity(attr: DataFrame) -> DataFrame:
    """Orders of the same week next to each order: counted per week, then joined back."""
    week = F.trunc("date", "week")
    per_week = attr.groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("weekly_order_velocity"))
    return attr.select("order_id", week.alias("week")).join(per_week, "week")


def revenue_shares(attr: DataFrame) -> DataFrame:
    def pct(c: str) -> Column:
        return money(ratio(c, "total_attributed_revenue") * 100)

    single = F.col("first_touch_channel") == F.col("last_touch_channel")
    return attr.select(
        "order_id",
        F.when(single, "single_touch").otherwise("multi_touch").alias("attribution_complexity"),
        pct("ads_attributed_revenue").alias("ads_attribution_percentage"),
        pct("email_attributed_revenue").alias("email_attribution_percentage"),
    )


def journey_scores(attr: DataFrame) -> DataFrame:
    n = F.col("touchpoint_count")
    single = F.col("first_touch_channel") == F.col("last_touch_channel")
    return attr.select(
        "order_id",
        ratio("total_attributed_revenue", F.col("ads_touches") + F.col("email_touches")).alias("revenue_per_touchpoint"),
        cases([(n == 1, "simple"), (n.between(2, 4), "moderate")], "complex").alias("journey_complexity"),
        cases([(single, 0.9), (n <= 3, 0.7)], 0.5).alias("attribution_confidence"),
    )


def journey_bins(attr: DataFrame) -> DataFrame:
    """Complexity bins (0,1], (1,3], (3,10] with no label outside, and two-level confidence."""
    n = F.col("touchpoint_count")
    single = F.col("first_touch_channel") == F.col("last_touch_channel")
    return attr.select(
        "order_id",
        cases([(n <= 0, F.lit(None).cast("string")), (n <= 1, "simple"), (n <= 3, "moderate"), (n <= 10, "complex")]).alias("journey_complexity"),
        cases([(single, 0.9)], 0.7).alias("attribution_confidence"),
    )


def clv_weighted_demand(attr: DataFrame) -> DataFrame:
    """Demand per product weighted by the mean value of each customer segment buying it."""
    seg = with_customer_segments(attr).select("order_id", "customer_segment", "lifetime_value")
    per_seg = attr.join(seg, "order_id").groupBy("product_id", "customer_segment").agg(F.count(F.lit(1)).alias("demand"), F.avg("lifetime_value").alias("clv"))
    return per_seg.groupBy("product_id").agg(ratio(F.sum(F.col("demand") * F.col("clv")), F.sum("clv")).alias("clv_weighted_demand"))


def channel_safety_stock(attr: DataFrame, days: int = 14, span: int = 30) -> DataFrame:
    """Base safety stock per product times the volatility of its revenue mix by last-touch channel."""
    mix = attr.groupBy("product_id", F.coalesce("last_touch_channel", F.lit("organic")).alias("channel")).agg(
        F.sum("total_attributed_revenue").alias("r"), F.count(F.lit(1)).alias("units")
    )
    vol = lookup("channel", CHANNEL_VOLATILITY, 1.0)
    return mix.groupBy("product_id").agg(
        (F.sum("units") / float(span) * days).alias("base_safety_stock"),
        ratio(F.sum(F.col("r") * vol), F.sum("r")).alias("volatility_multiplier"),
        (F.sum("units") / float(span) * days * ratio(F.sum(F.col("r") * vol), F.sum("r"))).alias("channel_safety_stock"),
    )


def attribution_kpis(attr: DataFrame) -> DataFrame:
    credited = F.col("ads_attributed_revenue") + F.col("email_attributed_revenue")
    return attr.groupBy("date").agg(
        ratio(F.sum(credited), F.sum("total_attributed_revenue")).alias("attribution_accuracy"),
        F.avg("touchpoint_count").alias("journey_complexity"),
        F.avg("journey_duration_hours").alias("time_to_conversion"),
        F.avg((F.col("touchpoint_count") > 1).cast("double")).alias("channel_assist_rate"),
        ratio(F.sum(credited), F.sum("touchpoint_count")).alias("revenue_per_touchpoint"),
    )
