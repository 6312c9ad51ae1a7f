import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from signalloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


JOB_SCHEMA = (
    "job_id string, organization string, source_job_id string, title string, description string, location string, country string, business_unit string, "
    "capability_classifications array<string>, skills array<string>, technologies array<string>, seniority_level string, is_leadership boolean, posted_date date, "
    "employment_type string, source_url string, evidence_id string"
)


def job(n, organization="Wells Fargo", location="Charlotte, NC", country="US", capabilities=(), seniority=None, leader=False, posted="2026-08-03", technologies=(), unit=None, title="Role", description="text", evidence=None):
    import datetime

    return (
        f"job-{organization[:3]}-{n}", organization, f"R-{n}", title, description, location, country, unit, list(capabilities), [], list(technologies), seniority, leader,
        datetime.date.fromisoformat(posted), None, f"https://example.com/{organization[:3]}/{n}", evidence or f"ev-{organization[:3]}-{n}",
    )


@pytest.fixture(scope="session")
def fixture_jobs(spark):
    rows = [
        job(1, capabilities=["Cloud", "Data"], seniority="senior"),
        job(2, location="New York, NY", capabilities=["Data"], seniority="director", leader=True),
        job(3, location="Austin, TX / Charlotte, NC", posted="2026-08-04"),
        job(4, location="Bengaluru, Karnataka, India", country="IN", capabilities=["Cloud", "Cloud"], seniority="manager", posted="2026-08-10"),
        job(5, location=" ", country="IN", capabilities=[""], posted="2026-08-11"),
        job(1, organization="Example Bank", location="London, United Kingdom", country="GB", capabilities=["Payments"], seniority="executive", leader=True),
    ]
    return spark.createDataFrame(rows, JOB_SCHEMA)
