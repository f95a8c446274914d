"""Run parameters as plain Python values.

Lists arrive as comma-separated strings (P19 ``csv_params``).  The parsing
rules differ per list and are part of the behaviour:

* keywords: split, strip, lower -- empty items are *kept* (an empty keyword
  matches every posting);
* every other list: split, strip, lower, drop empties;
* contact paths: split, strip, drop empties, case kept.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from .schema import KNOWN_FEEDS
from .sources.registry import LocalSearch

# Default parameter lists (must equal the reference's defaults).
DEFAULT_KEYWORDS = (
    "python,javascript,typescript,react,node.js,"
    "frontend,backend,fullstack,software engineer,developer,web developer,"
    "cybersecurity,security engineer,SOC analyst,pentester,"
    "infosec,ethical hacker,red team,blue team,cloud security,"
    "devops,automation,SRE"
)
DEFAULT_BLACKLIST = (
    "security clearance,active clearance,top secret,ts/sci,dod clearance,"
    "secret clearance,public trust,us citizens only,"
    "must be authorized to work in the us,us work authorization,"
    "must be a us citizen,green card required,"
    "sales executive,account executive,must relocate,relocation required,"
    "staffing agency,recruiting firm"
)
DEFAULT_LANGUAGES = "en,es"
DEFAULT_CONTACT_PATHS = "/contacto,/trabaja-con-nosotros,/bolsa-de-trabajo,/careers,/rh"
DEFAULT_JOBSPY_TERMS = "python,cybersecurity,software engineer,devops,javascript"
DEFAULT_ENABLED_FEEDS = (
    "jobspy,remoteok,remotive,wwr,cybersecjobs,computrabajo,bumeran,himalayas,"
    "hackernews,getonboard"
)
DEFAULT_MAX_YEARS = 3
DEFAULT_MAX_AGE_DAYS = 30
DEFAULT_DIGEST_SIZE = 10
DEFAULT_LEAD_DIGEST_SIZE = 30
DEFAULT_LEADS_PER_RUN = 100
DEFAULT_RADIUS_KM = 80
MAX_JOBSPY_TERMS = 5


def keywords_list(raw: str) -> list[str]:
    return [k.strip().lower() for k in raw.split(",")]


def clean_list(raw: str) -> list[str]:
    return [k.strip().lower() for k in raw.split(",") if k.strip()]


def paths_list(raw: str) -> list[str]:
    return [p.strip() for p in raw.split(",") if p.strip()]


def unknown_feeds(raw: str) -> list[str]:
    """Configured feed names minus known feed names (sorted)."""
    return sorted({n.strip().lower() for n in raw.split(",") if n.strip()} - set(KNOWN_FEEDS))


@dataclass(frozen=True)
class PostingParams:
    """Parameters of the postings flow.  ``None`` removes a filter conjunct."""

    keywords: tuple[str, ...] = tuple(keywords_list(DEFAULT_KEYWORDS))
    require_remote: bool | None = None  #: by default unless a local search is on, whose postings are not remote
    max_years: int | None = DEFAULT_MAX_YEARS
    max_age_days: int | None = DEFAULT_MAX_AGE_DAYS
    blacklist: tuple[str, ...] | None = tuple(clean_list(DEFAULT_BLACKLIST))
    allowed_languages: tuple[str, ...] | None = tuple(clean_list(DEFAULT_LANGUAGES))
    min_salary: float | None = None
    as_of: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))
    digest_size: int = DEFAULT_DIGEST_SIZE
    enabled_feeds: tuple[str, ...] = tuple(clean_list(DEFAULT_ENABLED_FEEDS))
    jobspy_terms: tuple[str, ...] = tuple(clean_list(DEFAULT_JOBSPY_TERMS))
    search: LocalSearch = LocalSearch()

    def __post_init__(self):
        if self.require_remote is None:
            object.__setattr__(self, "require_remote", not self.search.enabled)
        bad = sorted(set(self.enabled_feeds) - set(KNOWN_FEEDS))
        if bad:
            raise ValueError(f"Unknown feeds: {bad}. Known: {sorted(KNOWN_FEEDS)}")
        if len(self.jobspy_terms) > MAX_JOBSPY_TERMS:
            raise ValueError(
                f"at most {MAX_JOBSPY_TERMS} search terms, got {len(self.jobspy_terms)}")


@dataclass(frozen=True)
class LeadParams:
    lat: float
    lon: float
    radius_km: float = DEFAULT_RADIUS_KM
    contact_paths: tuple[str, ...] = tuple(paths_list(DEFAULT_CONTACT_PATHS))
    max_per_run: int | None = DEFAULT_LEADS_PER_RUN  # None: no cap
    digest_size: int = DEFAULT_LEAD_DIGEST_SIZE
