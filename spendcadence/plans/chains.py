"""From statement files to findings: parse and classify once into a table below the checkpoint folder, detect from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendcadence.operators import changes as CH
from spendcadence.operators import classify as CL
from spendcadence.operators import patterns as PT
from spendcadence.operators import risk as RK
from spendcadence.plans import oracle_base as S
from spendcadence.plans import spend
from spendcadence.plans.ingest import parsed_csv, parsed_pages
from spendcadence.plans.registry import query
from spendcadence.session import stored

PAGES, CSV = {"tx": S.tx_from_pages()}, {"tx": S.tx_from_csv()}


def _risks(tx: DataFrame) -> DataFrame:
    classified = stored(CL.classify_transactions(tx))
    found = RK.risk_report(
        PT.detect_subscriptions(classified), PT.detect_salary(classified), PT.detect_expenses(classified)
    )
    return found.select("*", "breakdown.*").drop("breakdown")


@query("chain_pages_salary", S.build(spend.SALARY_SQL, ["salary"], PAGES))
def pages_salary(spark: SparkSession, sf: str) -> DataFrame:
    return PT.detect_salary(stored(parsed_pages(spark, sf)))


@query("chain_pages_risk_report", S.build(spend.RISK_SQL, ["risks"], PAGES))
def pages_risk_report(spark: SparkSession, sf: str) -> DataFrame:
    return _risks(parsed_pages(spark, sf))


@query("chain_pages_price_changes", S.build(spend.CHANGES_SQL, ["jumps", "drift"], PAGES))
def pages_price_changes(spark: SparkSession, sf: str) -> DataFrame:
    return CH.detect_price_changes(stored(CL.classify_transactions(parsed_pages(spark, sf))))


@query("chain_csv_risk_report", S.build(spend.RISK_SQL, ["risks"], CSV))
def csv_risk_report(spark: SparkSession, sf: str) -> DataFrame:
    return _risks(parsed_csv(spark, sf))


@query("chain_csv_subscriptions", S.build(spend.SUBSCRIPTIONS_SQL, ["subscriptions"], CSV))
def csv_subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    return PT.detect_subscriptions(CL.classify_transactions(parsed_csv(spark, sf)))
