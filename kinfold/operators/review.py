"""The review queue: cases that stewards list, read and decide, kept as versions of a table beside the identity map.

The queue and the map are small next to the events: a decision rewrites one version of each. A decision that repeats the last one
changes nothing. The map is written before the queue, so a decision that broke off is repeated safely: renaming what
is renamed already, and adding an audit row that is there, change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Versioned
from .identity import DECISIONS, MOVES

CASE = (
    "case_id string, tenant_id string, case_type string, canonical_customer_id string, candidate_customer_id string, source_system string, source_record_id string, match_confidence double, status string, "
    "decision string, reviewer string, decision_reason string, created_at timestamp_ntz, updated_at timestamp_ntz, resolved_at timestamp_ntz"
)
MAP = "tenant_id string, source_system string, record_id string, canonical_customer_id string"
AUDIT = "audit_id string, tenant_id string, case_id string, kind string, from_id string, to_id string, source_system string, record_id string, reviewer string, reason string"


class CaseNotFound(KeyError):
    """No such case for this tenant."""


class ReviewQueue:
    """Cases, the identity map that decisions change, and the audit of those changes, each a ``Versioned`` table."""

    def __init__(self, cases: Versioned, mapping: Versioned, audit: Versioned):
        self.cases, self.mapping, self.audit = cases, mapping, audit

    def list(self, tenant: str | None = None, status: str | None = None, limit: int = 100, offset: int = 0) -> tuple[DataFrame, int]:
        """(a page in the order of (created_at, case_id), the total)."""
        rows = self.cases.read()
        if tenant is not None:
            rows = rows.where(F.col("tenant_id") == tenant)
        if status is not None:
            rows = rows.where(F.col("status") == status)
        return rows.orderBy("created_at", "case_id").offset(offset).limit(limit), rows.count()

    def get(self, case_id: str, tenant: str | None = None) -> dict | None:
        """One case; none for another tenant's."""
        rows = self.cases.read().where(F.col("case_id") == case_id)
        if tenant is not None:
            rows = rows.where(F.col("tenant_id") == tenant)
        row = rows.first()
        return None if row is None else row.asDict()

    def create(self, new: DataFrame) -> None:
        """Add cases; one whose id is there is replaced, but for the time it was created."""
        cols = self.cases.read().columns
        have = set(new.columns)
        given = new.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in cols]).dropDuplicates(["case_id"])
        old = self.cases.read()
        was = old.select("case_id", F.col("created_at").alias("__at"))
        kept = given.join(was, "case_id", "left").withColumn("created_at", F.coalesce("__at", "created_at")).select(*cols)
        self.cases.replace(_typed(old.join(given.select("case_id"), "case_id", "left_anti").select(*cols).unionByName(kept), old))

    def decide(self, case_id: str, decision: str, reviewer: str, reason: str, at, tenant: str | None = None) -> dict:
        """The case after a decision. Raises ``CaseNotFound``, or ``ValueError`` for a decision or a move that isn't allowed, a merge
        whose candidate has no rows in the tenant, an unmerge that doesn't name exactly one row."""
        case = self.get(case_id, tenant)
        if case is None:
            raise CaseNotFound(case_id)
        if (case["decision"], case["reviewer"], case["decision_reason"]) == (decision, reviewer, reason):
            return case
        if decision not in DECISIONS:
            raise ValueError(f"unknown decision {decision}")
        to = DECISIONS[decision]
        if to != case["status"] and to not in MOVES[case["status"]]:
            raise ValueError(f"{case['status']} can't become {to}")
        if decision == "APPROVE_MERGE":
            self._merge(case, reviewer, reason)
        elif decision == "APPROVE_UNMERGE":
            self._unmerge(case, reviewer, reason)
        own, when = F.col("case_id") == case_id, F.lit(at).cast("timestamp_ntz")
        values = {"status": F.lit(to), "decision": F.lit(decision), "reviewer": F.lit(reviewer), "decision_reason": F.lit(reason), "updated_at": when}
        if to == "RESOLVED":
            values["resolved_at"] = when
        rows = self.cases.read()
        self.cases.replace(rows.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in values.items()}))
        return self.get(case_id)

    def _merge(self, case: dict, reviewer: str, reason: str) -> None:
        """The candidate's rows become the customer's, within the tenant."""
        rows = self.mapping.read()
        own = (F.col("tenant_id") == case["tenant_id"]) & (F.col("canonical_customer_id") == case["candidate_customer_id"])
        if rows.where(own).isEmpty():
            if self._audited(case, "merge"):
                return  # done by a run that broke off
            raise ValueError("the candidate has no rows in the tenant")
        self._note(case, "merge", case["candidate_customer_id"], case["canonical_customer_id"], None, None, reviewer, reason)
        self.mapping.replace(rows.withColumn("canonical_customer_id",
            F.when(own, F.lit(case["canonical_customer_id"])).otherwise(F.col("canonical_customer_id"))))

    def _unmerge(self, case: dict, reviewer: str, reason: str) -> None:
        """One record becomes a customer of its own; no other row is touched."""
        rows = self.mapping.read()
        own = (F.col("tenant_id") == case["tenant_id"]) & (F.col("canonical_customer_id") == case["canonical_customer_id"])
        own = own & F.col("source_system").eqNullSafe(F.lit(case["source_system"])) & (F.col("record_id") == F.lit(case["source_record_id"]))
        n = rows.where(own).count()
        if n != 1:
            if n == 0 and self._audited(case, "unmerge"):
                return
            raise ValueError("an unmerge names exactly one row of the tenant")
        fresh = rows.select(F.concat(F.lit("cc_unmerge_"), F.substring(F.sha2(F.lit(case["case_id"]), 256), 1, 12))).first()[0]
        self._note(case, "unmerge", case["canonical_customer_id"], fresh, case["source_system"], case["source_record_id"], reviewer, reason)
        self.mapping.replace(rows.withColumn("canonical_customer_id", F.when(own, F.lit(fresh)).otherwise(F.col("canonical_customer_id"))))

    def _audited(self, case: dict, kind: str) -> bool:
        return not self.audit.read().where((F.col("case_id") == case["case_id"]) & (F.col("kind") == kind)).isEmpty()

    def _note(self, case: dict, kind: str, from_id: str, to_id: str, system: str | None, record: str | None, reviewer: str, reason: str) -> None:
        if self._audited(case, kind):
            return
        old = self.audit.read()
        values = (f"{kind}audit_{case['case_id']}", case["tenant_id"], case["case_id"], kind, from_id, to_id, system, record, reviewer, reason)
        self.audit.replace(old.unionByName(old.sparkSession.createDataFrame([values], old.schema)))


def _typed(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema])
