"""Categories: keywords, learned merchant rules, results of a classifier, imports without repeats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import merchant_name, signature

#: Default registry in order: id, type, keywords.  Any other can be given; order decides between hits.
REGISTRY = [
    ("groceries", "Expense", ["grocer", "supermarket", "market"]),
    ("dining", "Expense", ["restaurant", "cafe", "coffee", "pizza", "click"]),
    ("transportation", "Expense", ["uber", "taxi", "metro", "fuel", "parking"]),
    ("utilities", "Expense", ["electric", "water", "internet", "phone"]),
    ("housing", "Expense", ["rent", "mortgage"]),
    ("healthcare", "Expense", ["pharmacy", "hospital", "clinic"]),
    ("entertainment", "Expense", ["netflix", "spotify", "cinema", "prime", "view"]),
    ("shopping", "Expense", ["amazon", "store", "purchase"]),
    ("income", "Income", ["salary", "payroll", "signup"]),
    ("interest", "Income", ["interest earned"]),
    ("cashback", "Income", ["cashback"]),
    ("transfer", "Excluded", ["transfer", "error"]),
    ("bills", "Expense", ["bill"]),
    ("investment", "Excluded", ["mutual fund", "brokerage"]),
    ("insurance", "Expense", ["insurance", "premium"]),
    ("education", "Expense", ["tuition", "school"]),
    ("travel", "Expense", ["hotel", "airline", "flight"]),
    ("fees", "Expense", ["fee", "charge"]),
    ("taxes", "Expense", ["tax"]),
    ("interest-expense", "Expense", ["finance charge"]),
    ("other", "Excluded", []),
]
REVIEW_BELOW = 0.85


def keyword_category(description: Column, txn_type: Column, registry=REGISTRY) -> Column:
    """The first category, in order, one of whose keywords occurs: first those of the direction's type or excluded ones,
    then the others.  Without a hit a credit is the first income category, a debit 'other'."""
    text = F.lower(F.coalesce(description, F.lit("")))

    def first(kinds: set[str]) -> Column:
        out = F.lit(None).cast("string")
        for name, kind, words in reversed(registry):
            if kind in kinds and words:
                hit = F.lit(False)
                for w in words:
                    hit = hit | text.contains(w.lower())
                out = F.when(hit, name).otherwise(out)
        return out

    income = next((c[0] for c in registry if c[1] == "Income"), "other")
    credit = F.coalesce(first({"Income", "Excluded"}), first({"Expense"}), F.lit(income))
    return F.when(txn_type == "credit", credit).otherwise(F.coalesce(first({"Expense", "Excluded"}), first({"Income"}), F.lit("other")))


def match_rules(txns: DataFrame, rules: DataFrame) -> DataFrame:
    """id, rule_category of rows (id, merchant_key, direction, source_type) with a rule.

    A rule fits by key, and by direction and source or 'any'.  The most specific fits count; if those name two
    categories, none does; else the most confirmed and latest.
    """
    r = rules.filter("not ambiguous").select(F.col("merchant_key").alias("rk"), F.col("direction").alias("rd"), F.col("source_type").alias("rs"), "category", "confirmations", "confirmed_at")
    fits = (F.col("merchant_key") == F.col("rk")) & ((F.col("rd") == F.col("direction")) | (F.col("rd") == "any")) & ((F.col("rs") == F.col("source_type")) | (F.col("rs") == "any"))
    df = txns.select("id", "merchant_key", "direction", "source_type").join(r, fits).withColumn("specific", (F.col("rd") != "any").cast("int") + (F.col("rs") != "any").cast("int"))
    tier = df.groupBy("id", "specific").agg(F.min("category").alias("low"), F.max("category").alias("high"), F.max(F.struct("confirmations", "confirmed_at", "category")).alias("best"))
    top = tier.groupBy("id").agg(F.max(F.struct("specific", "low", "high", "best")).alias("t"))
    return top.filter("t.low = t.high").select("id", F.col("t.best.category").alias("rule_category"))


def learn_rules(decisions: DataFrame) -> DataFrame:
    """Rules after decisions (merchant_key, direction, source_type, category, at) in order of time.

    The first category stays.  The same again confirms it and clears doubt, another one casts doubt: so confirmations
    count the first category's decisions, and a rule is ambiguous if the latest decision names another.  Both come from
    aggregates that merge, however many decisions a merchant has.
    """
    key = ["merchant_key", "direction", "source_type"]
    decision = F.struct("at", "category")
    each = decisions.groupBy(*key, "category").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min(decision).alias("first"), F.max(decision).alias("last"))
    df = each.groupBy(*key).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("n", "first").alias("confirmations"))
    return df.select(*key, "first.category", "confirmations", (~F.col("first.category").eqNullSafe(F.col("last.category"))).alias("ambiguous"), F.col("last.at").alias("confirmed_at"))


def mark_ambiguous(rules: DataFrame, doubted: DataFrame) -> DataFrame:
    """Rules with the ones that ``doubted`` (merchant_key, direction, source_type) names marked."""
    key = ["merchant_key", "direction", "source_type"]
    df = rules.join(doubted.select(*key).distinct().withColumn("_doubt", F.lit(True)), key, "left")
    return df.withColumn("ambiguous", F.col("ambiguous") | F.coalesce("_doubt", F.lit(False))).select(*rules.columns)


def match_results(batch: DataFrame, results: DataFrame, registry=REGISTRY) -> DataFrame:
    """id, category, confidence, by of a batch's rows: a classifier's result (id, new_category, confidence), or keywords."""
    df = batch.join(results.select("id", "new_category", F.col("confidence").alias("_c")), "id", "left")
    word = keyword_category(F.col("description"), F.col("type"), registry)
    return df.select("id", F.coalesce("new_category", word).alias("category"), F.when(F.col("new_category").isNull(), F.lit(0.3)).otherwise(F.col("_c")).alias("confidence"), F.when(F.col("new_category").isNull(), "keyword").otherwise("model").alias("by"))


def import_categories(rows: DataFrame, registry=REGISTRY) -> DataFrame:
    """Rows of an import with merchant, and with a keyword category, low confidence and a review where nothing has put
    them into a category before."""
    had = (F.coalesce("category", F.lit("other")) != "other") | F.col("categorized_by").isNotNull() | F.col("category_confidence").isNotNull() | F.col("needs_review").isNotNull()
    pick = lambda old, new: F.when(had, F.col(old)).otherwise(new)
    return rows.withColumns(
        {
            "merchant": merchant_name(F.col("description")),
            "category": pick("category", keyword_category(F.col("description"), F.col("type"), registry)),
            "category_confidence": pick("category_confidence", F.lit(0.3)),
            "needs_review": pick("needs_review", F.lit(True)),
            "categorized_by": pick("categorized_by", F.lit("keyword")),
        }
    )


def recategorize(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """Rows with the categories chosen by hand (id, chosen); those need no review.  The choices are decisions of learn_rules()."""
    df = rows.join(choices.select("id", "chosen"), "id", "left")
    hit = F.col("chosen").isNotNull()
    return df.withColumns({"category": F.coalesce("chosen", "category"), "needs_review": F.when(hit, False).otherwise(F.col("needs_review")), "categorized_by": F.when(hit, "manual").otherwise(F.col("categorized_by"))}).drop("chosen")


def category_info(rows: DataFrame, own: DataFrame, defaults: DataFrame) -> DataFrame:
    """Add name and kind of each row's category: from the user's own list, else the default one (id, name, kind), else
    made from the id.  Both lists are a user's categories, some dozens."""
    side = lambda df, c: df.select(F.col("id").alias(f"_{c}"), F.col("name").alias(f"_{c}_name"), F.col("kind").alias(f"_{c}_kind"))
    df = rows.join(side(own, "u"), F.col("category") == F.col("_u"), "left").join(side(defaults, "d"), F.col("category") == F.col("_d"), "left")
    made = F.concat(F.upper(F.substring("category", 1, 1)), F.expr("substring(category, 2)"))
    return df.withColumns({"category_name": F.coalesce("_u_name", "_d_name", made), "category_kind": F.coalesce("_u_kind", "_d_kind", F.lit("Excluded"))}).drop("_u", "_u_name", "_u_kind", "_d", "_d_name", "_d_kind")


def trim_rules(rules: DataFrame, most: int = 1000) -> DataFrame:
    return rules.orderBy(F.col("confirmed_at").desc(), "merchant_key", "direction", "source_type").limit(most)


def apply_results(txns: DataFrame, results: DataFrame) -> DataFrame:
    """Categories of a classifier (id, new_category, confidence) put on rows; doubtful ones are marked for review."""
    df = txns.join(results, "id", "left")
    return df.withColumns({"category": F.coalesce("new_category", "category"), "needs_review": F.coalesce(F.col("confidence") < REVIEW_BELOW, F.lit(False))}).drop("new_category")


def rules_first(txns: DataFrame, rules: DataFrame, registry=REGISTRY) -> DataFrame:
    """id, category, confidence, by: transfers and investments stay; else a rule, else keywords."""
    df = txns.join(match_rules(txns, rules), "id", "left")
    skip = F.col("category").isin("transfer", "investment")
    word = keyword_category(F.col("description"), F.col("type"), registry)
    return df.select("id", F.when(skip, F.col("category")).otherwise(F.coalesce("rule_category", word)).alias("new_category"), F.when(skip, 1.0).when(F.col("rule_category").isNotNull(), 0.98).otherwise(0.3).alias("confidence"), F.when(skip, "kept").when(F.col("rule_category").isNotNull(), "rule").otherwise("keyword").alias("by"))


def only_new(batch: DataFrame, history: DataFrame, within: bool = False) -> DataFrame:
    """Rows of a batch whose signature the history lacks; repeats within the batch stay unless ``within``."""
    sig = lambda df: df.withColumn("_sig", signature(F.col("date"), F.col("amount"), F.col("description")))
    df = sig(batch).join(sig(history).select("_sig").distinct(), "_sig", "left_anti")
    if within:
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy("_sig").orderBy("ord"))).filter("_n = 1").drop("_n")
    return df.drop("_sig")


def keep_best(rows: DataFrame, keys: list[str], score: str = "confidence", order: str = "ord") -> DataFrame:
    """One row of equal keys: the best score, then the first."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), order))).filter("_n = 1").drop("_n")


def update_rows(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Changes by key; a null changes nothing."""
    names = [c for c in changes.columns if c != key]
    df = rows.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names]), key, "left")
    return df.withColumns({c: F.coalesce(f"_new_{c}", c) for c in names}).drop(*[f"_new_{c}" for c in names]).select(*rows.columns)


def classify_with(rows: DataFrame, client, batch: int = 20) -> DataFrame:
    """id, new_category, confidence from ``client(list of (id, description))`` called on each task for ``batch`` rows at a
    time; the client is any picklable function returning (id, category, confidence) tuples."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame(client(list(zip(part["id"], part["description"], strict=True))), columns=["id", "new_category", "confidence"])

    return rows.select("id", "description").mapInPandas(run, f"id {kind}, new_category string, confidence double")
