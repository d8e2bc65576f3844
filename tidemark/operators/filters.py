"""The optional predicates of a listing. Each set one becomes a column expression, so that Spark combines and pushes them down."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _items(value: str | None) -> list[str]:
    return sorted({v.strip().lower() for v in value.split(",") if v.strip()}) if value else []


def _names(value: str | None) -> list[str]:
    return [v.strip() for v in value.split(",") if v.strip()] if value else []


@dataclass(frozen=True)
class Filters:
    """Comma lists mean any of; an unset or unknown value filters nothing."""

    include_closed: bool = False
    ids: str | None = None
    days: int | None = None
    since: str | None = None
    role: str | None = None
    seniority: str | None = None
    experience: str | None = None
    degree: str | None = None
    employees: str | None = None
    sector: str | None = None
    position: str | None = None
    confirmed_days: int | None = None
    org_size: str | None = None
    enrollment: str | None = None
    city: str | None = None
    company: str | None = None
    exclude_companies: str | None = None
    exclude_agencies: bool = False
    english_only: bool = False
    language: str | None = None
    sponsorship: bool = False
    remote: str | None = None
    skill: str | None = None
    skills_any: str | None = None
    q: str | None = None

    def conditions(self, as_of: str) -> list[Column]:
        now = F.lit(as_of).cast("timestamp_ntz")
        ago = lambda days: now - F.expr(f"interval {int(days)} days")
        c, found = F.col, []
        if not self.include_closed:
            found.append(c("closed_at").isNull())
        if self.ids:
            found.append(c("id").isin([int(x) for x in _names(self.ids) if x.isdigit()]))
        if self.days:
            found.append(c("effective_at") >= ago(self.days))
        if self.since:
            try:
                at = datetime.fromisoformat(self.since.replace("Z", ""))
                found.append(c("first_seen") > F.lit(str(at)).cast("timestamp_ntz"))
            except ValueError:
                pass
        for name, column in (("role", "role_family"), ("seniority", "seniority"), ("experience", "experience"), ("degree", "degree"), ("employees", "employee_band"), ("sector", "sector"), ("position", "position"), ("org_size", "org_size")):
            if wanted := _items(getattr(self, name)):
                found.append(c(column).isin(wanted))
        if self.confirmed_days:
            found.append(c("confirmed_at") >= ago(self.confirmed_days))
        asked = c("enrollment_required")
        if self.enrollment == "open":
            found.append(~asked.eqNullSafe(True))
        elif self.enrollment == "required":
            found.append(asked.eqNullSafe(True))
        elif self.enrollment == "stated_open":
            found.append(asked.eqNullSafe(False))
        if wanted := _items(self.city):
            here = F.coalesce(F.lower("city").isin(wanted), F.lit(False)) | F.coalesce(F.exists("also_in", lambda x: F.lower(x).isin(wanted)), F.lit(False))
            found.append(here | c("remote") if "remote" in wanted else here)
        if self.company:
            found.append(F.lower("company") == self.company.lower())
        if wanted := _items(self.exclude_companies):
            found.append(~F.lower("company").isin(wanted))
        if self.exclude_agencies:
            found.append(c("kind") != "agency")
        if self.english_only or self.language == "en":
            found.append(c("english_only").eqNullSafe(True))
        elif self.language == "nl":
            found.append((c("dutch_required") | (c("posting_language") == "nl")) & c("english_required").eqNullSafe(False))
        if self.sponsorship:
            found.append(c("visa_sponsorship").eqNullSafe(True))
        wanted = _items(self.remote)
        if wanted and not {"remote", "hybrid", "onsite"} <= set(wanted):
            told = F.coalesce(c("remote_policy").isin(wanted), F.lit(False))
            flagged = c("remote") & (c("remote_policy").isNull() | c("remote_policy").isin("unknown", "remote"))
            found.append(told | flagged if "remote" in wanted else told)
        if self.skill:
            found.append(F.array_contains("skills", self.skill))
        if wanted := _names(self.skills_any):
            found.append(F.arrays_overlap("skills", F.array(*map(F.lit, wanted))))
        if self.q and self.q.strip():
            text = self.q.strip().lower()
            found.append(F.lower("title").contains(text) | F.lower("company").contains(text) | F.exists("skills", lambda s: F.lower(s).contains(text)))
        return found

    def apply(self, rows: DataFrame, as_of: str) -> DataFrame:
        for condition in self.conditions(as_of):
            rows = rows.where(condition)
        return rows

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]
