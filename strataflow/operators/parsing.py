"""Rule-based parsers of sentences: payments, states, relationships and preferences.

Each takes texts and returns their columns with one row per match. Rules are regular expressions over whole texts, in
JVM expressions; what no rule matches gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions.text import number_of

# The rules. Groups are in the order of the fields that each parser names.
_NAME = r"[A-Z]\w+"
_NAMES = r"[A-Z]\w*(?:\s+[A-Z]\w*)*"
PAYMENT = (
    r"\b([A-Z]\w+)\s+(?:paid|gave|sent|lent|owes)\s+([A-Z]\w+)\s+([$€£]?[\d.,]+k?|[a-z-]+(?:\s[a-z-]+){0,3}?)(?:\s(?:dollars|euros|pounds))?(?:\s+for\s+([^.!?]+))?(?=[.!?]|$|\s)"
)
SPLIT = rf"\b({_NAME}): [Pp]aid ([$€£]?[\d.,]+k?)(?: for ([^.!?-]+?))?\s*-\s*split (?:with|among) ([^.!?]+)"
_SUBJECT = rf"\b(I|{_NAME})(?:'m|'ve|\s+(?:am|is|was|has|have|just|recently|now|currently))*\s+"
STATES = (
    ("location", "lives_in", _SUBJECT + rf"(?:live|lives|living|moved|moving|relocated|relocating|settled)\s+(?:in|to|near)\s+({_NAMES})"),
    ("work", "works_at", _SUBJECT + rf"(?:work|works|working|joined|started|employed)\s+(?:at|for)?\s*({_NAMES})"),
    ("work", "works_as", _SUBJECT + r"(?:work|works|working|promoted)\s+(?:as|to)\s+(?:an?\s+)?([a-z]+(?:\s[a-z]+)?)"),
    ("education", "studies", _SUBJECT + rf"(?:study|studies|studying|enrolled)\s+(?:at|in)?\s*({_NAMES}|[a-z]+)"),
)
RELATIONSHIPS = (
    ("works_with", rf"\b(I|{_NAME})\s+(?:work|works|worked|working)\s+with\s+({_NAME})"),
    ("colleague", rf"\b(I|{_NAME})\s+(?:am|is|was)\s+an?\s+(?:colleague|coworker)\s+of\s+({_NAME})"),
    ("friend", rf"\b(I|{_NAME})\s+(?:am|is|are|was)\s+(?:a\s+friend\s+of|(?:good |close )?friends\s+with)\s+({_NAME})"),
    ("friend", rf"\b({_NAME})\s+and\s+({_NAME})\s+are\s+(?:good |close |best )?friends"),
    ("spouse", rf"\b(I|{_NAME})\s+(?:am|is|was)\s+married\s+to\s+({_NAME})"),
    ("spouse", rf"\b(I|{_NAME})\s+married\s+({_NAME})"),
    ("manager", rf"\b(I|{_NAME})\s+(?:report|reports)\s+to\s+({_NAME})"),
    ("knows", rf"\b(I|{_NAME})\s+(?:know|knows|met)\s+({_NAME})"),
)
PREFERENCES = (
    (1.0, r"\b(I|[A-Z]\w+)\s+(?:really\s+|absolutely\s+)?(?:love|loves|adore|adores)\s+([^.!?,;]+)"),
    (0.7, r"\b(I|[A-Z]\w+)\s+(?:really\s+)?(?:like|likes|enjoy|enjoys|prefer|prefers)\s+([^.!?,;]+)"),
    (-0.7, r"\b(I|[A-Z]\w+)\s+(?:really\s+)?(?:dislike|dislikes|don't like|doesn't like)\s+([^.!?,;]+)"),
    (-1.0, r"\b(I|[A-Z]\w+)\s+(?:really\s+)?(?:hate|hates|can't stand)\s+([^.!?,;]+)"),
)
CATEGORIES = {
    "food": ("coffee", "tea", "pizza", "pasta", "sushi", "food", "restaurant", "cake", "bread", "wine", "cooking"),
    "music": ("music", "jazz", "rock", "concert", "song", "band", "guitar", "piano"),
    "sport": ("football", "tennis", "running", "swimming", "yoga", "cycling", "hiking", "sport"),
    "travel": ("travel", "beach", "museum", "hotel", "city", "park", "mountains"),
    "media": ("book", "books", "movie", "movies", "film", "series", "reading", "novel"),
}


def _matches(df: DataFrame, text: str, pattern: str, fields: list[str]) -> DataFrame:
    """``df`` with a row per match, and the pattern's groups as ``fields``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.arrays_zip(*(F.regexp_extract_all(whole, F.lit(pattern), F.lit(i)).alias(f) for i, f in enumerate(fields, 1)))
    return df.select("*", F.explode(found).alias("_m")).select(*df.columns, *(F.trim(F.col(f"_m.{f}")).alias(f) for f in fields))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _who(name: str) -> Column:
    return F.when(F.col(name) == "I", F.lit("user")).otherwise(F.col(name)).alias(name)


def parse_ledger(texts: DataFrame, text: str = "text") -> DataFrame:
    """Payments in sentences such as "Alice paid Bob $12.50 for lunch": payer, payee, amount, note."""
    m = _matches(texts, text, PAYMENT, ["payer", "payee", "amount", "note"])
    amount = number_of(F.regexp_replace("amount", "[.,]+$", ""))
    return m.withColumn("amount", amount).withColumn("note", F.when(F.col("note") != "", F.col("note"))).where("amount is not null")


def parse_splits(texts: DataFrame, text: str = "text") -> DataFrame:
    """Shared payments such as "Ann: Paid €30 for dinner - split with Bob, Cy": payer, payee, amount (the payee's equal share), note.

    The payer carries a share too.
    """
    m = _matches(texts, text, SPLIT, ["payer", "amount", "note", "others"])
    people = F.filter(F.split("others", r"\s*(?:,|\band\b)\s*"), lambda p: p.rlike("^[A-Z]"))
    share = number_of(F.regexp_replace("amount", "[.,]+$", "")) / (F.size(people) + 1)
    return m.select(*texts.columns, "payer", F.explode(people).alias("payee"), share.alias("amount"), "note").where("amount is not null")


def parse_states(texts: DataFrame, text: str = "text") -> DataFrame:
    """States such as "I moved to Lisbon": entity, category, predicate, target."""
    parts = [_matches(texts, text, p, ["entity", "target"]).select(*texts.columns, _who("entity"), F.lit(c).alias("category"), F.lit(k).alias("predicate"), "target") for c, k, p in STATES]
    return _union(parts)


def parse_relationships(texts: DataFrame, text: str = "text") -> DataFrame:
    """Relationships such as "Alice works with Bob": subject, predicate, object."""
    parts = [_matches(texts, text, p, ["subject", "object"]).select(*texts.columns, _who("subject"), F.lit(k).alias("predicate"), "object") for k, p in RELATIONSHIPS]
    return _union(parts)


def preference_category(item: Column) -> Column:
    """The first category of which a word is in the item, else general."""
    out = F.when(F.lit(False), F.lit(""))
    for name, words in CATEGORIES.items():
        out = out.when(F.lower(item).rlike(rf"\b({'|'.join(words)})\b"), F.lit(name))
    return out.otherwise(F.lit("general"))


def parse_preferences(texts: DataFrame, text: str = "text") -> DataFrame:
    """Preferences such as "I really love jazz": entity, item, sentiment (-1 to 1), category."""
    parts = [_matches(texts, text, p, ["entity", "item"]).select(*texts.columns, _who("entity"), "item", F.lit(s).alias("sentiment"), preference_category(F.col("item")).alias("category")) for s, p in PREFERENCES]
    return _union(parts)
