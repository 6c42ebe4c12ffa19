"""Label operators: learned sender mappings, rule-based categories,
fallback categories, frequent-sender labels, label centroids, nearest
centroid, and the ranked suggestion waterfall.

Suggestions are ``struct<label, specificity:int, confidence:double,
reason>`` values; a mail's suggestions are an array of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import nearest as NE

# ---------------------------------------------------------------------------
# Category labels and keyword lists of the rule-based
# categoriser and of the fallback categories (plain substring matches).
# ---------------------------------------------------------------------------
NEWSLETTER_TECH = "Bot/Newsletter-Tech"
NEWSLETTER_FINANCE = "Bot/Newsletter-Finance"
NEWSLETTER_NEWS = "Bot/Newsletter-News"
NEWSLETTER_OTHER = "Bot/Newsletter-Other"
PROMOTIONAL = "Bot/Promotional"
AUTOMATED = "Bot/Automated"
PERSONAL = "Bot/Personal"
WORK = "Bot/Work"
RECEIPTS = "Bot/Receipts"
LOW_CONFIDENCE = "Bot/LowConfidence"
AUTO_ARCHIVED = "Bot/AutoArchived"

TECH_KEYWORDS = [
    "ai", "ml", "machine learning", "artificial intelligence",
    "programming", "coding", "developer", "software", "tech",
    "python", "javascript", "react", "api", "github", "code",
    "startup", "saas", "cloud", "aws", "docker", "kubernetes",
    "data science", "devops", "engineering",
]
FINANCE_KEYWORDS = [
    "finance", "investing", "stock", "market", "trading",
    "crypto", "bitcoin", "ethereum", "blockchain",
    "money", "wealth", "portfolio", "dividend", "etf",
    "banking", "credit", "mortgage", "loan",
]
NEWS_KEYWORDS = [
    "news", "daily briefing", "newsletter", "digest",
    "politics", "world", "breaking", "update",
    "today", "this week", "weekly roundup",
]
PROMO_INDICATORS = [
    "sale", "discount", "offer", "deal", "coupon",
    "limited time", "expires", "save", "off",
    "free shipping", "buy now", "shop now",
    "special offer", "exclusive",
]
AUTOMATED_INDICATORS = [
    "notification", "alert", "reminder", "automated",
    "no-reply", "noreply", "do not reply",
    "[github]", "[jira]", "[confluence]", "[slack]",
    "pull request", "issue", "commit", "build failed",
]
RECEIPT_INDICATORS = [
    "receipt", "order confirmation", "invoice", "payment",
    "thank you for your purchase", "order has been",
    "shipped", "delivery", "tracking",
]
WORK_ADDRESS_MARKERS = ["@company.com", ".edu"]
WORK_SUBJECT_KEYWORDS = ["meeting", "calendar", "invitation", "project", "team", "review", "feedback", "deadline"]

# Fallback categories, checked in this order.
FALLBACK_RECEIPT = ("Bot/Receipts", ["receipt", "order confirmation", "invoice", "payment", "shipped"])
FALLBACK_AUTOMATED = ("Bot/Automated", ["notification", "alert", "no-reply", "noreply", "automated"])
FALLBACK_PROMOTIONAL = ("Bot/Promotional", ["sale", "discount", "offer", "deal", "coupon", "% off"])
FALLBACK_NEWSLETTER = "Bot/Newsletters"
FALLBACK_DEFAULT = "Bot/Personal"

SPECIFICITY_THRESHOLD = 3
SIMILARITY_THRESHOLD = 0.75
SEMANTIC_MIN_CONFIDENCE = 0.4

SUGGESTION_TYPE = "struct<label:string,specificity:int,confidence:double,reason:string>"


def suggestion(label: Column, specificity: int, confidence: Column | float, reason: Column | str) -> Column:
    conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    rsn = reason if isinstance(reason, Column) else F.lit(reason)
    return F.struct(
        label.cast("string").alias("label"),
        F.lit(specificity).cast("int").alias("specificity"),
        conf.cast("double").alias("confidence"),
        rsn.alias("reason"),
    )


def category_text(subject: str | Column = "subject", snippet: str | Column = "snippet") -> Column:
    return F.lower(F.concat(F.coalesce(C.col(subject), F.lit("")), F.lit(" "), F.coalesce(C.col(snippet), F.lit(""))))


# ---------------------------------------------------------------------------
# Learned sender mappings
# ---------------------------------------------------------------------------


def _address_map(mappings: DataFrame) -> DataFrame:
    return (
        mappings.filter(F.col("sender_address").isNotNull())
        .groupBy("sender_address")
        .agg(F.min_by("label", "mapping_id").alias("_addr_label"))
    )


def _domain_map(mappings: DataFrame) -> DataFrame:
    return (
        mappings.filter(F.col("sender_address").isNull() & F.col("sender_domain").isNotNull())
        .groupBy("sender_domain")
        .agg(F.min_by("label", "mapping_id").alias("_dom_label"))
    )


def with_learned_label(
    emails: DataFrame, mappings: DataFrame, domain_rule: str = "last", out: str = "learned_label"
) -> DataFrame:
    """Address mapping first, else a domain-only mapping, else NULL.

    ``domain_rule='last'``: text after the last '@' (categoriser and the
    repository lookup); ``'first'``: second '@' field (adaptive labels).
    Both keep the case.  Mapping tables are joined, not broadcast blindly:
    AQE broadcasts them when their measured size is small.
    """
    dom = C.raw_domain_last("from_address") if domain_rule == "last" else C.raw_domain_first("from_address")
    am = _address_map(mappings)
    dm = _domain_map(mappings)
    j = emails.withColumn("_dom_key", dom)
    j = j.join(am, j["from_address"] == am["sender_address"], "left").drop("sender_address")
    j = j.join(dm, j["_dom_key"] == dm["sender_domain"], "left").drop("sender_domain")
    learned = F.coalesce("_addr_label", "_dom_label")
    if domain_rule == "last":
        learned = F.when(C.blank_to_null("from_address").isNotNull(), learned)
    return j.withColumn(out, learned).drop("_addr_label", "_dom_label", "_dom_key")


# ---------------------------------------------------------------------------
# Rule-based categories
# ---------------------------------------------------------------------------


def is_work_email(address: str | Column = "from_address", subject: str | Column = "subject") -> Column:
    a = F.lower(F.coalesce(C.col(address), F.lit("")))
    s = F.lower(F.coalesce(C.col(subject), F.lit("")))
    return C.contains_any(a, WORK_ADDRESS_MARKERS) | C.contains_any(s, WORK_SUBJECT_KEYWORDS)


def rule_category(text: Column, is_newsletter: Column, work: Column) -> Column:
    return (
        F.when(C.contains_any(text, RECEIPT_INDICATORS), F.lit(RECEIPTS))
        .when(C.contains_any(text, AUTOMATED_INDICATORS), F.lit(AUTOMATED))
        .when(C.contains_any(text, PROMO_INDICATORS), F.lit(PROMOTIONAL))
        .when(
            F.coalesce(is_newsletter, F.lit(False)),
            F.when(C.contains_any(text, TECH_KEYWORDS), F.lit(NEWSLETTER_TECH))
            .when(C.contains_any(text, FINANCE_KEYWORDS), F.lit(NEWSLETTER_FINANCE))
            .when(C.contains_any(text, NEWS_KEYWORDS), F.lit(NEWSLETTER_NEWS))
            .otherwise(F.lit(NEWSLETTER_OTHER)),
        )
        .when(work, F.lit(WORK))
        .otherwise(F.lit(PERSONAL))
    )


def categorize(emails: DataFrame, mappings: DataFrame, is_newsletter: str = "is_newsletter") -> DataFrame:
    """Adds ``category``: learned label if any, else the keyword waterfall."""
    # The text is its own column first: an expression that is used often is
    # then computed once per row instead of once per keyword.
    j = with_learned_label(emails, mappings, "last", "learned_label").withColumn("_text", category_text())
    cat = F.coalesce(
        F.col("learned_label"),
        rule_category(F.col("_text"), F.col(is_newsletter), is_work_email()),
    )
    return j.withColumn("category", cat).drop("_text")


def confidence_labels(base: Column, confidence: Column) -> Column:
    return F.concat(F.array(base), F.when(confidence == "low", F.array(F.lit(LOW_CONFIDENCE))).otherwise(F.array().cast("array<string>")))


def action_labels(labels: Column, action: Column) -> Column:
    return F.concat(labels, F.when(action == "archive", F.array(F.lit(AUTO_ARCHIVED))).otherwise(F.array().cast("array<string>")))


# ---------------------------------------------------------------------------
# Fallback and sender-specific suggestions
# ---------------------------------------------------------------------------


def fallback_suggestion(text: Column, is_newsletter: Column) -> Column:
    (r_label, r_kw), (a_label, a_kw), (p_label, p_kw) = FALLBACK_RECEIPT, FALLBACK_AUTOMATED, FALLBACK_PROMOTIONAL
    return (
        F.when(C.contains_any(text, r_kw), suggestion(F.lit(r_label), 4, 0.5, "Matched receipt keywords"))
        .when(C.contains_any(text, a_kw), suggestion(F.lit(a_label), 4, 0.5, "Matched automated keywords"))
        .when(C.contains_any(text, p_kw), suggestion(F.lit(p_label), 4, 0.5, "Matched promotional keywords"))
        .when(
            F.coalesce(is_newsletter, F.lit(False)),
            suggestion(F.lit(FALLBACK_NEWSLETTER), 4, 0.6, "Detected as newsletter (List-Unsubscribe header)"),
        )
        .otherwise(suggestion(F.lit(FALLBACK_DEFAULT), 5, 0.3, "Default category"))
    )


def sender_specific_suggestion(address: Column, sender_count: Column, threshold: int = SPECIFICITY_THRESHOLD) -> Column:
    dom = C.raw_domain_first(address)
    lab = C.domain_to_label(dom)
    return F.when(
        (sender_count >= threshold) & address.contains("@") & lab.isNotNull(),
        suggestion(F.concat(F.lit("Bot/"), lab), 3, 0.5, F.concat(F.lit("Frequent sender from "), dom)),
    )


# ---------------------------------------------------------------------------
# Centroids and nearest centroid
# ---------------------------------------------------------------------------


def _mapped_features(emails: DataFrame, features: DataFrame, mappings: DataFrame) -> DataFrame:
    """Feature rows of the mail of mapped senders, with their label."""
    m = mappings.filter(F.col("sender_address").isNotNull()).select(
        F.col("sender_address").alias("from_address"), "label"
    ).distinct()
    return (
        emails.select("message_id", "from_address", "date")
        .join(m, "from_address")
        .join(features.select("message_id", "subject_embedding"), "message_id")
    )


def sender_sample(emails: DataFrame, features: DataFrame, mappings: DataFrame, per_sender: int = 10) -> DataFrame:
    """Up to ``per_sender`` feature rows of each mapped sender (newest
    first, message_id breaks ties); the cap is applied before empty
    embeddings are dropped.  ``row_number() <= k`` plans a partial
    WindowGroupLimit before the shuffle, so a hot sender ships at most k
    rows per map task."""
    j = _mapped_features(emails, features, mappings)
    w = Window.partitionBy("label", "from_address").orderBy(F.col("date").desc(), F.col("message_id"))
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_sender)


def label_centroids(emails: DataFrame, features: DataFrame, mappings: DataFrame, per_sender: int | None = None) -> DataFrame:
    """(label, centroid array<double>, n): element-wise mean of the subject
    embeddings of all mail of each mapped label's senders; ``per_sender``
    takes the newest so many of each sender (the application takes 10)."""
    if per_sender:
        s = sender_sample(emails, features, mappings, per_sender)
    else:
        s = _mapped_features(emails, features, mappings)
    s = s.filter(F.size("subject_embedding") > 0)
    ex = s.select("label", "message_id", F.posexplode("subject_embedding").alias("pos", "v"))
    per_dim = ex.groupBy("label", "pos").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return per_dim.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("centroid"),
        F.max("n").alias("n"),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0.0 when either side is NULL, empty or has zero norm."""
    na, nb = norm(a), norm(b)
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(b) > 0) & (na > 0) & (nb > 0)
    return F.when(ok, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


MAX_PACKED_LABELS = 5000


def nearest_label(
    features: DataFrame, centroids: DataFrame, emb_col: str = "subject_embedding", threshold: float = SIMILARITY_THRESHOLD,
    blocks: int = 1, by: list[str] | None = None, packed_labels: int = MAX_PACKED_LABELS,
) -> DataFrame:
    """Best centroid with cosine strictly above ``threshold`` (zero-norm
    centroids skipped; the first label in label order wins ties).

    Up to ``packed_labels`` labels are folded into a single array value and
    attached as a scalar subquery: no join and no cross product; the work is
    one array pass per mail.  More labels, or labels of many mailboxes
    (``by``, columns of both tables), go through inverted lists that give the
    same result (see ``nearest``).  The centroids, one row per label, are
    written once so that counting them does not compute them twice.
    ``blocks`` takes the packed labels in so many passes over the mail.
    """
    if by or blocks == 1:
        centroids = NE.stored(centroids.select(*(by or []), "label", "centroid"), "centroids")
        if by or centroids.count() > packed_labels:
            mail = features.select(*(by or []), "message_id", F.col(emb_col).alias("v"))
            best = NE.nearest(mail, centroids.withColumnRenamed("centroid", "v"), threshold, by)
            return features.select(*(by or []), "message_id").join(best, [*(by or []), "message_id"], "left").withColumnRenamed("label", "nearest_label")
    if blocks > 1:
        part = F.pmod(F.xxhash64("label"), F.lit(blocks))
        best = [_packed_nearest(features, centroids.filter(part == b), emb_col, threshold) for b in range(blocks)]
        every = reduce(DataFrame.unionByName, best).groupBy("message_id")
        # Highest similarity, then the first label: the order of the struct.
        top = every.agg(F.min(F.when(F.col("nearest_label").isNotNull(), F.struct((-F.col("similarity")).alias("s"), "nearest_label"))).alias("b"))
        return top.select("message_id", F.col("b.nearest_label").alias("nearest_label"), (-F.col("b.s")).alias("similarity"))
    return _packed_nearest(features, centroids, emb_col, threshold)


def _packed_nearest(features: DataFrame, centroids: DataFrame, emb_col: str, threshold: float) -> DataFrame:
    packed = centroids.agg(
        F.array_sort(F.collect_list(F.struct("label", "centroid", norm(F.col("centroid")).alias("cn")))).alias("cs"),
    ).scalar()
    # The subquery is projected as its own column first: subqueries may not
    # sit inside a lambda.
    # The mail's norm is computed once per row, not once per centroid inside
    # the lambda.
    features = features.select("message_id", emb_col, norm(F.col(emb_col)).alias("_en")).withColumn("_cs", packed)
    e = F.col(emb_col)
    en = F.col("_en")
    sims = F.transform(
        F.filter(F.col("_cs"), lambda c: c["cn"] > 0),
        lambda c: F.struct(c["label"].alias("label"), (dot(e, c["centroid"]) / (en * c["cn"])).alias("sim")),
    )
    init = F.struct(F.lit(None).cast("string").alias("label"), F.lit(threshold).cast("double").alias("sim"))
    best = F.aggregate(sims, init, lambda acc, x: F.when(x["sim"] > acc["sim"], x).otherwise(acc))
    ok = e.isNotNull() & (F.size(e) > 0) & (en > 0)
    return features.select(
        "message_id",
        F.when(ok, best["label"]).alias("nearest_label"),
        F.when(ok & best["label"].isNotNull(), best["sim"]).alias("similarity"),
    )


# ---------------------------------------------------------------------------
# Waterfall
# ---------------------------------------------------------------------------


def suggestions_column(
    learned: Column,
    semantic: Column,
    centroid: Column,
    sender_specific: Column,
    fallback: Column,
) -> Column:
    """Ranked suggestions.  A learned label is returned alone; otherwise
    semantic, centroid (if its label differs from the first suggestion),
    sender-specific (same rule), fallback (if its label is not already
    present), stably sorted by specificity."""
    cent = F.when(semantic.isNull() | (centroid["label"] != semantic["label"]), centroid)
    first = F.coalesce(semantic, cent)
    send = F.when(first.isNull() | (sender_specific["label"] != first["label"]), sender_specific)
    before = F.array_compact(F.array(semantic, cent, send))
    fb = F.when(~F.array_contains(F.transform(before, lambda s: s["label"]), fallback["label"]), fallback)
    allv = F.array_compact(F.array(semantic, cent, send, fb))
    ranked = F.transform(
        F.array_sort(F.transform(allv, lambda s, i: F.struct(s["specificity"].alias("k"), i.alias("i"), s.alias("s")))),
        lambda x: x["s"],
    )
    learned_only = F.array(suggestion(learned, 1, 1.0, "Learned from user feedback"))
    return F.when(learned.isNotNull(), learned_only).otherwise(ranked)


def generate_labels(
    emails: DataFrame,
    features: DataFrame,
    mappings: DataFrame,
    centroids: DataFrame | None = None,
    semantic: DataFrame | None = None,
    threshold: int = SPECIFICITY_THRESHOLD,
    sender_counts: DataFrame | None = None,
) -> DataFrame:
    """message_id + ``suggestions`` for each mail in ``emails``.

    ``features`` holds message_id, is_newsletter, subject_embedding;
    ``semantic`` (optional) holds message_id, sem_label, sem_confidence;
    ``centroids`` defaults to the label centroids of ``mappings``;
    ``sender_counts`` (message_id, sender_count) overrides the per-sender
    mail counts of ``emails`` (the triage run passes its visible counts).
    """
    base = emails.select("message_id", "from_address", "subject", "snippet").join(
        features.select("message_id", "is_newsletter", "subject_embedding"), "message_id", "left"
    )
    if sender_counts is None:
        counts = emails.groupBy("from_address").agg(F.count(F.lit(1)).alias("_sender_count"))
        base = base.join(counts, "from_address", "left")
    else:
        base = base.join(sender_counts.select("message_id", F.col("sender_count").alias("_sender_count")), "message_id", "left")
    base = with_learned_label(base, mappings, "first", "_learned")
    has_emb = F.col("subject_embedding").isNotNull() & (F.size("subject_embedding") > 0)
    if centroids is None:
        centroids = label_centroids(emails, features, mappings)
    near = nearest_label(base.select("message_id", "subject_embedding"), centroids)
    base = base.join(near, "message_id", "left")
    cent = F.when(
        has_emb & F.col("nearest_label").isNotNull(),
        suggestion(
            F.col("nearest_label"), 2, F.col("similarity"),
            F.concat(F.lit("Similar to existing "), F.col("nearest_label"), F.lit(" emails")),
        ),
    )
    if semantic is not None:
        base = base.join(semantic.select("message_id", "sem_label", "sem_confidence"), "message_id", "left")
        sem = F.when(
            has_emb & (F.col("sem_confidence") >= SEMANTIC_MIN_CONFIDENCE),
            suggestion(F.concat(F.lit("Bot/"), F.col("sem_label")), 2, F.col("sem_confidence"), "Semantic classifier"),
        )
    else:
        sem = F.lit(None).cast(SUGGESTION_TYPE)
    send = sender_specific_suggestion(F.col("from_address"), F.coalesce(F.col("_sender_count"), F.lit(0)), threshold)
    fb = fallback_suggestion(category_text(), F.col("is_newsletter"))
    sug = suggestions_column(F.col("_learned"), sem, cent, send, fb)
    return base.select("message_id", sug.alias("suggestions"))


def primary_label(suggestions: Column) -> Column:
    return F.coalesce(F.element_at(suggestions, 1)["label"], F.lit("Bot/Uncategorized"))


def max_labels(suggestions: Column, n: int = 2) -> Column:
    return F.transform(F.slice(suggestions, 1, n), lambda s: s["label"])


def triage_labels(suggestions: Column, action: Column, confidence: Column) -> Column:
    """Primary label, the second if different, + LowConfidence if low,
    + AutoArchived if archiving."""
    cat = primary_label(suggestions)
    second = F.element_at(suggestions, 2)["label"]
    base = F.concat(
        F.array(cat),
        F.when((F.size(suggestions) > 1) & (second != cat), F.array(second)).otherwise(F.array().cast("array<string>")),
    )
    with_conf = F.concat(base, F.when(confidence == "low", F.array(F.lit(LOW_CONFIDENCE))).otherwise(F.array().cast("array<string>")))
    return action_labels(with_conf, action)
