"""Blast radius: what an account reaches. Two fixed hops, access and stored data, for all employees at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# An invented organisation: (id, name, kind, sensitivity), who may open what by department, and what lies where.
SERVICES = [
    ("idp", "Sign-in portal", "identity_provider", "high"), ("mail", "Mailboxes", "email", "high"),
    ("files", "File share", "file_storage", "medium"), ("hr", "HR desk", "internal_app", "high"),
    ("books", "Bookkeeping", "internal_app", "high"), ("fleet", "Fleet planner", "internal_app", "medium"),
    ("crm", "Customer desk", "internal_app", "medium"), ("admin", "Admin console", "internal_app", "high"),
    ("payroll_data", "Payroll records", "data", "high"), ("ledger_data", "Ledgers", "data", "high"),
    ("route_data", "Route plans", "data", "medium"), ("customer_data", "Customer records", "data", "high"),
    ("contract_data", "Contracts", "data", "medium"), ("config_data", "Configuration", "data", "high"),
]
DEPENDENCIES = [
    ("idp", "mail", "signs in to"), ("idp", "files", "signs in to"), ("idp", "hr", "signs in to"), ("idp", "books", "signs in to"),
    ("idp", "fleet", "signs in to"), ("idp", "crm", "signs in to"), ("idp", "admin", "signs in to"), ("admin", "idp", "manages"),
    ("hr", "payroll_data", "stores"), ("books", "ledger_data", "stores"), ("fleet", "route_data", "stores"),
    ("crm", "customer_data", "stores"), ("files", "contract_data", "stores"), ("admin", "config_data", "stores"),
]
ACCESS = {
    "Finance": ["mail", "files", "books"], "Human Resources": ["mail", "files", "hr"], "IT": ["mail", "admin", "files"],
    "Logistics": ["fleet"], "Sales": ["mail", "crm"], "Management": ["mail", "files", "books", "hr", "crm"],
}


def reach(employees: DataFrame) -> DataFrame:
    """(employee_id, service_id): the sign-in portal, own services and the data stored in them."""
    spark = employees.sparkSession
    access = spark.createDataFrame([(d, s) for d, ss in ACCESS.items() for s in [*ss, "idp"]], "department string, service_id string")
    data = {s for s, _, kind, _ in SERVICES if kind == "data"}
    stored = spark.createDataFrame([(a, b) for a, b, _ in DEPENDENCIES if b in data], "service_id string, data_id string")
    own = employees.select("employee_id", "department").join(F.broadcast(access), "department").select("employee_id", "service_id")
    inside = own.join(F.broadcast(stored), "service_id").select("employee_id", F.col("data_id").alias("service_id"))
    return own.unionByName(inside)


def _reaches(service: str) -> list[str]:
    """The departments that reach a service: all of them the portal, the others by access or by what is stored in it."""
    holders = {b: a for a, b, relation in DEPENDENCIES if relation == "stores"}
    return [d for d, own in ACCESS.items() if service == "idp" or holders.get(service, service) in own]


def _known(employees: DataFrame) -> DataFrame:
    """(employee_id, n, r): a row for each id, its number of rows, and for each service the number of rows that reach it. The
    access list is a fixed table, so nothing is joined; an id that occurs more than once keeps the rows that joins would give."""
    counted = employees.groupBy("employee_id").agg(F.count("*").cast("int").alias("n"), *[
        F.count_if((F.col("department") == d) & F.col("employee_id").isNotNull()).cast("int").alias(d) for d in ACCESS])
    rows = [sum((F.col(f"`{d}`") for d in _reaches(i)), F.lit(0)).alias(i) for i, *_ in SERVICES]
    return counted.select("employee_id", "n", F.struct(*rows).alias("r"))


def _repeated(rows: DataFrame, times) -> DataFrame:
    return rows.withColumn("__times", F.explode(F.array_repeat(F.lit(0), times))).drop("__times")


def nodes(employees: DataFrame) -> DataFrame:
    """(employee_id, node, kind, at_risk): every service, marked when reachable, and the colleagues node."""
    listed = [(i, k if k in ("identity_provider", "data") else "service", i) for i, _, k, _ in SERVICES] + [("colleagues", "people", "mail")]
    every = _known(employees).select("employee_id", "n", F.explode(F.array(*[F.struct(
        F.lit(i).alias("node"), F.lit(k).alias("kind"), F.col("r")[of].alias("hits")) for i, k, of in listed])).alias("s")).select("employee_id", "n", "s.*")
    return _repeated(every, F.col("n") * F.greatest("hits", F.lit(1))).select("employee_id", "node", "kind", (F.col("hits") > 0).alias("at_risk"))


def edges(employees: DataFrame) -> DataFrame:
    """(employee_id, source, target, lit): an edge is lit when both its ends are at risk."""
    fixed = [*[(a, b, a, b) for a, b, _ in DEPENDENCIES], *[(i, "colleagues", i, "mail") for i, _, k, _ in SERVICES if k == "email"]]
    drawn = _known(employees.where("employee_id is not null")).select("employee_id", "n", F.explode(F.array(*[F.struct(
        F.lit(a).alias("source"), F.lit(b).alias("target"), F.col("r")[x].alias("x"), F.col("r")[y].alias("y")) for a, b, x, y in fixed])).alias("e")).select("employee_id", "n", "e.*")
    ends = F.greatest("x", F.lit(1)) * F.greatest("y", F.lit(1))
    return _repeated(drawn, F.col("n") * F.col("n") * F.col("n") * ends).select("employee_id", "source", "target", ((F.col("x") > 0) & (F.col("y") > 0)).alias("lit"))
