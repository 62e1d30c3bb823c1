"""Rule-based model recommendations, role advice and answers, all from column profiles."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators.profiling import clean, profile_dataframe

# Names of target columns, score tables and words of questions.
TARGET_HINTS = ("target", "label", "class", "y", "outcome", "result")
LARGE_ROWS, SMALL_ROWS, HIERARCHICAL_ROWS, HIGH_DIM, IMBALANCE, MANY_VALUES = 20_000, 200, 5_000, 0.5, 4.0, 15


@dataclass
class Algorithm:
    name: str
    score: float
    reasons: list[str] = field(default_factory=list)
    caveats: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {"name": self.name, "score": round(min(max(self.score, 0.0), 1.0), 3), "reasons": self.reasons, "caveats": self.caveats}


@dataclass
class Traits:
    n_rows: int
    n_features: int
    ratio: float
    has_categorical: bool
    has_high_cardinality: bool
    has_outliers: bool
    missing: float


@dataclass
class Recommendation:
    target: str | None
    problem: str
    auto_detected: bool
    traits: Traits
    balance: dict | None
    algorithms: list[Algorithm]
    notes: list[str]


def detect_target(profiles: list[Row]) -> str | None:
    """A column named like a target, or else the first boolean, or else the first with few categories."""
    for hint in TARGET_HINTS:
        for p in profiles:
            if p.column_name.lower() == hint or p.column_name.lower().endswith("_" + hint):
                return p.column_name
    tests = (lambda p: p.kind == "boolean", lambda p: p.kind == "categorical" and 2 <= p.n_unique <= 20)
    return next((p.column_name for test in tests for p in profiles if test(p)), None)


def problem_type(target: Row | None) -> str:
    if target is None:
        return "clustering"
    if target.kind == "boolean" or target.kind == "categorical" and target.n_unique == 2:
        return "binary_classification"
    return "multiclass_classification" if target.kind == "categorical" else "regression"


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """``class`` and ``n`` for every class of a target, however many there are."""
    return df.select(clean(df, target).cast("string").alias("class")).where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, target: str) -> dict | None:
    """Number of classes, the largest one's ratio to the least, and the counts of all as a table; None below two classes."""
    sizes = class_counts(df, target)
    row = sizes.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("most"), F.min("n").alias("least")).first()
    if row.k < 2:
        return None
    ratio = row.most / row.least
    return {"classes": row.k, "ratio": round(ratio, 2), "is_imbalanced": ratio >= IMBALANCE, "class_counts": sizes}


def traits(profiles: list[Row], target: str | None) -> Traits:
    rest = [p for p in profiles if p.column_name != target]
    n_rows = profiles[0].non_null + profiles[0].nulls if profiles else 0
    return Traits(
        n_rows, len(rest), round(len(rest) / n_rows, 4) if n_rows else 0.0, any(p.kind == "categorical" for p in rest),
        any(p.kind in ("categorical", "identifier") and p.n_unique > MANY_VALUES for p in rest), any(p.n_outliers for p in rest),
        round(sum(p.null_ratio for p in rest) / len(rest), 4) if rest else 0.0,
    )


def score_algorithms(problem: str, t: Traits, imbalanced: bool = False) -> list[Algorithm]:
    """Base scores with adjustments, best first; ties stay in the order of the table."""
    large, high_dim = t.n_rows > LARGE_ROWS, t.ratio > HIGH_DIM
    mixed = t.has_categorical or t.has_high_cardinality or t.has_outliers
    small, big_tree = t.n_rows < SMALL_ROWS, t.n_rows > HIERARCHICAL_ROWS
    boost = [(small, -0.30), (not small, 0.10)]
    forest = [(mixed, 0.10), (high_dim, -0.15)]
    # name, base, [(condition, change)], [(condition, reason)], [(condition, caveat)]
    tables = {
        "classification": [
            ("Logistic Regression", 0.60, [(high_dim, 0.10)], [(high_dim, "regularises many features")], [(imbalanced, "needs class weights")]),
            ("Random Forest", 0.75, forest, [(mixed, "takes mixed columns and outliers")], [(high_dim, "many features for few rows"), (imbalanced, "needs class weights")]),
            ("Gradient Boosting", 0.70, boost, [], [(small, "overfits few rows")]),
            ("Support Vector Machine", 0.50, [(large, -0.30)], [], [(large, "slow on many rows")]),
            ("K-Nearest Neighbors", 0.40, [(large or high_dim, -0.20)], [], [(large or high_dim, "distances are slow or blurred")]),
            ("Naive Bayes", 0.35, [(t.has_categorical, 0.10)], [], []),
        ],
        "regression": [
            ("Linear Regression", 0.55, [], [], [(t.has_outliers, "moved by outliers")]),
            ("Ridge / Lasso Regression", 0.55, [(high_dim, 0.20)], [(high_dim, "regularises many features")], []),
            ("Random Forest Regressor", 0.75, forest, [(mixed, "takes mixed columns and outliers")], [(high_dim, "many features for few rows")]),
            ("Gradient Boosting Regressor", 0.70, boost, [], [(small, "overfits few rows")]),
            ("Support Vector Regression", 0.45, [(large, -0.30)], [], [(large, "slow on many rows")]),
        ],
        "clustering": [
            ("K-Means", 0.65, [], [], [(t.has_outliers, "moved by outliers")]),
            ("DBSCAN", 0.55, [(t.has_outliers, 0.15)], [(t.has_outliers, "sets outliers apart")], []),
            ("Hierarchical (Agglomerative) Clustering", 0.45, [(big_tree, -0.20)], [], [(big_tree, "quadratic in rows")]),
        ],
    }
    found = []
    for name, score, changes, reasons, caveats in tables[problem.rpartition("_")[2]]:
        for holds, change in changes:
            if holds:
                score += change
        found.append(Algorithm(name, score, [r for holds, r in reasons if holds], [c for holds, c in caveats if holds]))
    return sorted(found, key=lambda a: -a.score)


def recommend_algorithms(df: DataFrame, target_column: str | None = None, profiles: list[Row] | None = None) -> Recommendation:
    profiles = profiles or profile_dataframe(df)
    by_name = {p.column_name: p for p in profiles}
    if target_column is not None and target_column not in by_name:
        raise ValueError(f"no column {target_column}")
    target = target_column or detect_target(profiles)
    problem = problem_type(by_name.get(target))
    t, balance = traits(profiles, target), class_balance(df, target) if target else None
    imbalanced = bool(balance and balance["is_imbalanced"])
    notes = []
    if t.missing > 0:
        notes.append(f"{t.missing:.1%} of values are missing: impute them first")
    if imbalanced:
        notes.append(f"classes are imbalanced ({balance['ratio']}:1)")
    if t.has_high_cardinality:
        notes.append("columns of high cardinality need label or target encoding")
    if target is None:
        notes.append("no target column was found")
    return Recommendation(target, problem, target_column is None, t, balance, score_algorithms(problem, t, imbalanced), notes)


class AdvisorBackend(Protocol):
    """What an advisor must offer; the rule-based one is the default."""

    def suggest_column_role(self, profile: Row) -> tuple[str, float]: ...

    def explain_step(self, step: Row) -> str: ...


class RuleAdvisor:
    def suggest_column_role(self, profile: Row) -> tuple[str, float]:
        if profile.kind == "identifier":
            return "identifier", 0.8
        if profile.null_ratio > 0.9:
            return "drop_candidate", 0.6
        return "feature", 0.5 if profile.kind in ("numeric", "categorical", "boolean", "datetime") else 0.3

    def explain_step(self, step: Row) -> str:
        changes = {"rows": step.rows_after - step.rows_before, "columns": step.columns_after - step.columns_before, "missing values": step.nulls_after - step.nulls_before}
        return f"{step.description}: {', '.join(f'{n} {d:+d}' for n, d in changes.items())}, {len(step.warnings)} warning(s)."


INTENTS = {
    "recommend": ("recommend", "model", "algorithm", "predict", "train"),
    "data_quality": ("missing", "null", "nan", "quality", "incomplete"),
    "outlier": ("outlier", "anomal", "extreme"),
}


def detect_intent(message: str) -> str:
    text = message.lower()
    return next((name for name, words in INTENTS.items() if any(w in text for w in words)), "summary")


def intent_expr(message):
    """The same for a column."""
    text, out = F.lower(message), F.lit("summary")
    for name, words in reversed(INTENTS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def answer_question(question: str, df: DataFrame, name: str, *, audit_trail: list[Row] | None = None, target_column: str | None = None) -> dict:
    """An answer and the figures behind it."""
    if not question.strip():
        raise ValueError("the question is empty")
    intent = detect_intent(question)
    profiles = profile_dataframe(df)
    if intent == "recommend":
        r = recommend_algorithms(df, target_column, profiles)
        best = " or ".join(a.name for a in r.algorithms[:2])
        return {"intent": intent, "answer": f"For {r.problem.replace('_', ' ')} on {name}, try {best}.", "data": [a.to_dict() for a in r.algorithms[:5]]}
    if intent == "data_quality":
        gaps = {p.column_name: p.nulls for p in profiles if p.nulls}
        answer = f"{name} has {sum(gaps.values())} missing values in {len(gaps)} column(s)."
        if gaps:
            answer += f" Most are in {max(gaps, key=gaps.get)}."
        for step in audit_trail or []:
            if step.step == "impute_missing":
                answer += f" Imputation filled {step.nulls_before - step.nulls_after} of {step.nulls_before}."
        return {"intent": intent, "answer": answer, "data": gaps}
    if intent == "outlier":
        odd = {p.column_name: p.n_outliers for p in profiles if p.n_outliers}
        return {"intent": intent, "answer": f"{name} has outliers in {len(odd)} column(s)." if odd else f"{name} has no outliers.", "data": odd}
    kinds: dict[str, int] = {}
    for p in profiles:
        kinds[p.kind] = kinds.get(p.kind, 0) + 1
    rows = profiles[0].nulls + profiles[0].non_null if profiles else 0
    return {"intent": intent, "answer": f"{name} has {rows} rows and {len(profiles)} columns.", "data": kinds | {"missing": sum(p.nulls for p in profiles)}}
