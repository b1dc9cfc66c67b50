"""The acceptance run makes its survey once: what it returns is read from written rows, not from plans of the whole run."""

from fluxline.plans import adapters as A
from fluxline.plans import qc
from fluxline.plans.registry import SPEC


def test_results_do_not_make_the_survey_anew(spark):
    d = "/root/testdata/sf0.001"
    result = qc.run_qc(A.events_survey(spark, d), SPEC, A.base_station(spark, d))
    for name in ("survey", "flags", "scorecard", "lines", "stats", "crossovers", "coefficients"):
        files = getattr(result, name).inputFiles()
        assert files and not any("events.parquet" in f for f in files), name
    for check in result.results.values():
        assert not any("events.parquet" in f for f in check.flags.inputFiles())
    assert {r["check"] for r in result.scorecard.collect()} == {c for c, _ in qc.CHECKS}
