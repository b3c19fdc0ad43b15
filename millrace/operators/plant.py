"""Quality, equipment and production reports. A window of days ends at as_of, by default the latest date of the data; rows
without a date fall out of a window, as they compare with nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import exact


def recent(df: DataFrame, date: str, days: int, as_of: str | None = None) -> DataFrame:
    """Rows from `days` before as_of on."""
    if as_of is not None:
        return df.where(F.col(date) >= F.date_sub(F.lit(as_of).cast("date"), days))
    return df.crossJoin(F.broadcast(df.agg(F.max(date).alias("_last")))).where(F.col(date) >= F.date_sub("_last", days)).drop("_last")


def money(name: str, alias: str):
    return F.sum(exact(F.col(name))).cast("double").alias(alias)


def nonconformance_status(ncm: DataFrame, action: DataFrame) -> DataFrame:
    """Each non-conformance with its corrective actions, if it has any."""
    actions = action.select("ncm_id", "action_description", "effectiveness_score", F.col("status").alias("capa_status"))
    return ncm.select("ncm_id", "material_type", "detection_date", "disposition_status", "quantity_affected").join(actions, "ncm_id", "left")


def nonconformance_by_employee(ncm: DataFrame, employee: DataFrame) -> DataFrame:
    people = employee.select(F.col("employee_id").alias("assigned_employee_id"), "first_name", "last_name")
    return ncm.select("ncm_id", "detection_date", "assigned_employee_id").join(people, "assigned_employee_id", "left").select("ncm_id", "detection_date", "first_name", "last_name")


def incidents_by_severity(incident: DataFrame, days: int = 90, as_of: str | None = None) -> DataFrame:
    return recent(incident, "incident_date", days, as_of).groupBy("severity_level").agg(F.count("*").alias("incident_count"), F.round(F.avg("resolution_time_hours"), 4).alias("avg_resolution_hours"), money("cost_impact", "total_cost_impact"))


def oee_metrics(metric: DataFrame, days: int = 7, as_of: str | None = None) -> DataFrame:
    percent = lambda rate, name: F.round(F.col(rate) * 100, 1).alias(name)
    return recent(metric, "measurement_date", days, as_of).select(
        "equipment_id", "equipment_name", "measurement_date", percent("availability_rate", "availability_pct"), percent("performance_rate", "performance_pct"),
        percent("quality_rate", "quality_pct"), percent("oee_score", "oee_pct"), "downtime_hours",
    )


def downtime_by_category(downtime: DataFrame, days: int = 30, as_of: str | None = None) -> DataFrame:
    return recent(downtime, "event_date", days, as_of).groupBy("downtime_category").agg(
        F.count("*").alias("event_count"), F.sum("duration_minutes").alias("total_downtime_mins"), F.round(F.avg("duration_minutes"), 0).alias("avg_downtime_mins"),
        F.sum("production_loss_units").alias("total_production_loss"), money("cost_impact", "total_cost_impact"),
    )


def failures(equipment: DataFrame, failure: DataFrame, days: int = 180, as_of: str | None = None) -> DataFrame:
    """Failures by equipment; equipment without one in the window drops out, though the join keeps it."""
    rows = equipment.join(recent(failure, "failure_date", days, as_of), "equipment_id")
    return rows.groupBy("equipment_id", "equipment_name").agg(F.count("failure_id").alias("failure_count"), F.round(F.sum("downtime_hours"), 4).alias("total_downtime"), F.round(F.avg("repair_cost"), 4).alias("avg_repair_cost"), F.round(F.avg("mtbf_impact"), 4).alias("avg_mtbf_hours"))


def schedule_adherence(schedule: DataFrame, days: int = 7, as_of: str | None = None) -> DataFrame:
    done = F.round(F.col("actual_quantity") / F.when(F.col("target_quantity") != 0, F.col("target_quantity")) * 100, 1)
    return recent(schedule, "planned_start", days, as_of).select("schedule_id", "line_id", "planned_start", "actual_start", "target_quantity", "actual_quantity", done.alias("completion_pct"), "efficiency_score")


def line_performance(line: DataFrame, schedule: DataFrame, days: int = 30, as_of: str | None = None) -> DataFrame:
    rows = line.join(recent(schedule, "planned_start", days, as_of), "line_id")
    return rows.groupBy("line_id", "line_name", "line_type").agg(F.count("schedule_id").alias("scheduled_runs"), F.sum("target_quantity").alias("total_target"), F.sum("actual_quantity").alias("total_actual"), F.round(F.avg("efficiency_score") * 100, 1).alias("avg_efficiency_pct"))


def quality_costs(cost: DataFrame, days: int = 30, as_of: str | None = None) -> DataFrame:
    return recent(cost, "cost_date", days, as_of).groupBy("cost_category", "cost_subcategory").agg(money("cost_amount", "total_cost"), F.sum("units_affected").alias("total_units"), F.round(F.avg("cost_per_unit"), 2).alias("avg_cost_per_unit"), F.count("*").alias("incident_count"))


def defects_for(defect: DataFrame, perspective: str) -> DataFrame:
    """Defect records as finance (with a cost), customers (with an impact on them) or quality (by severity) see them."""
    if perspective == "finance":
        return defect.where("ncm_cost > 0").select("defect_id", "severity_level", "ncm_cost", "cost_category", F.round(F.col("repair_cost") + F.col("scrap_cost"), 2).alias("total_cost_impact"))
    if perspective == "customer":
        return defect.where("customer_impact_flag = 1").select("defect_id", "severity_level", "customer_impact_flag", "complaint_id", "customer_notification_date")
    if perspective == "quality":
        return defect.where(F.col("severity_level").isin("Critical", "Major", "Minor")).select("defect_id", "severity_level", "defect_type", "root_cause", "quality_score")
    raise ValueError(f"unknown perspective {perspective!r}")
