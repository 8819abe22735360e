"""Ordered label rules: the first rule with a matching pattern gives the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Sequence[str]]]

# Practice labels of the deal reports, in order of precedence.
DEAL_PRACTICES: Rules = (
    ("Advisory", ("%advisory%",)),
    ("AppDev", ("%appdev%", "%application%")),
    ("Cloud", ("%cloud%",)),
    ("Data Protection", ("%data protection%",)),
    ("Data", ("%data%",)),
    ("EMA", ("%ema%",)),
    ("ESM", ("%esm%",)),
    ("EUC", ("%euc%",)),
    ("Managed Services", ("%ms%", "%managed%")),
    ("Modern Infrastructure", ("%modern%",)),
    ("Network", ("%network%",)),
    ("Security", ("%security%",)),
)
# Fixed value: a deal without a known practice carries this text, not NULL.
NO_PRACTICE = "Null"

# Practice labels of the utilization reports, in order of precedence.
STAFF_PRACTICES: Rules = (
    ("Advisory", ("%advisory%",)),
    ("AppDev", ("%appdev%", "%application%")),
    ("Cloud", ("%cloud%",)),
    ("Next Gen Data Center PMs", ("%next gen data%",)),
    ("Digital Solutions PMs", ("%digital solutions%",)),
    ("Data", ("%data%",)),
    ("EMA", ("%ema%",)),
    ("ESM", ("%esm%",)),
    ("EUC", ("%euc%",)),
    ("Managed Services", ("%ms%", "%managed%")),
    ("Modern Infrastructure", ("%mod%",)),
    ("Network", ("%network%",)),
    ("Security", ("%security%",)),
    ("DevOps", ("%devops%",)),
    ("TSA", ("%tsa%",)),
    ("Products", ("products",)),
)

# Consultant roles, all by prefix. "managing principle" is the spelling
# found in the data; "managing principal" is not matched.
CONSULTANT_ROLES: Rules = (
    ("Associate Technical Consultant", ("associate technical%",)),
    ("Consultant", ("consultant:%",)),
    ("Delivery Manager", ("delivery manager%",)),
    ("Engineer", ("engineer%",)),
    ("Managing Principal", ("managing principle%",)),
    ("Principal Consultant", ("principal consultant%",)),
    ("Principal Technical Consultant", ("principal technical consultant%",)),
    ("Program Manager", ("program manager%",)),
    ("Project Manager", ("project manager%",)),
    ("Senior Associate Technical Consultant", ("senior associate technical%",)),
    ("Senior Consultant", ("senior consultant%",)),
    ("Senior Technical Consultant", ("senior technical consultant%",)),
    ("Team Lead", ("team lead%",)),
    ("Technical Consultant", ("technical consultant%",)),
)


def staff_practices(house_brand: str | None = None) -> Rules:
    """The utilization rules; a house brand adds its "<brand> Services" rule after DevOps."""
    if house_brand is None:
        return STAFF_PRACTICES
    after = [label for label, _ in STAFF_PRACTICES].index("DevOps") + 1
    own = (f"{house_brand} Services", (f"%{house_brand}%",))
    return (*STAFF_PRACTICES[:after], own, *STAFF_PRACTICES[after:])


def case_sql(lowered: str, rules: Rules, default: str = "NULL") -> str:
    """SQL of the label of the first rule with a pattern that a lower-case text matches, else ``default``."""

    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    arms = [
        f"WHEN {lowered} LIKE ANY ({', '.join(quoted(p.lower()) for p in patterns)})"
        f" THEN {quoted(label)}"
        for label, patterns in rules
    ]
    return f"CASE {' '.join(arms)} ELSE {default} END"


def label_by_rules(
    df: DataFrame, column: str, rules: Rules, default: str = "NULL", name: str | None = None
) -> DataFrame:
    """``df`` with the label of the first rule that has a matching pattern, else ``default``.

    ``default`` is a SQL expression, such as a quoted text or the column itself. The label
    goes to column ``name``, or replaces the column. Patterns are in lower case; the text is
    lowered once per row, in a projection of its own, rather than in every test. Where rows are folded, label what is
    left of them: the rules then run once for each value of a group.
    """
    label = F.expr(case_sql("_lower", rules, default))
    return df.withColumn("_lower", F.lower(column)).withColumn(name or column, label).drop("_lower")


def with_deal_practice(deals: DataFrame, rules: Rules = DEAL_PRACTICES) -> DataFrame:
    """Replaces the practice of deals by its label."""
    return label_by_rules(deals, "practice", rules, f"'{NO_PRACTICE}'")
