"""Registered quality, equipment and production queries."""

from millrace.operators import plant as op
from pyspark.sql import functions as F

from .define import Registry

plans = Registry()
add = plans.add
SUM = "cast(sum(cast({} as decimal(18, 2))) as double)"
text = lambda df, *columns: df.withColumns({c: F.col(c).cast("string") for c in columns})


def since(date: str, days: int, table: str) -> str:
    return f"{date} >= (select max({date}) - {days} from {{{table}}})"


add("q02_nonconformance_status", lambda t: text(op.nonconformance_status(t["ncm"], t["corrective_action"]), "detection_date"), """
  select n.ncm_id, material_type, cast(detection_date as varchar) as detection_date, disposition_status, quantity_affected, action_description, effectiveness_score, c.status as capa_status
  from {ncm} n left join {corrective_action} c on c.ncm_id = n.ncm_id""")
add("q02_nonconformance_by_employee", lambda t: text(op.nonconformance_by_employee(t["ncm"], t["employee"]), "detection_date"), """
  select ncm_id, cast(detection_date as varchar) as detection_date, first_name, last_name from {ncm} left join {employee} on employee_id = assigned_employee_id""")
add("q03_incidents_by_severity", lambda t: op.incidents_by_severity(t["quality_incident"]), f"""
  select severity_level, count(*) as incident_count, round(avg(resolution_time_hours), 4) as avg_resolution_hours, {SUM.format('cost_impact')} as total_cost_impact
  from {{quality_incident}} where {since('incident_date', 90, 'quality_incident')} group by 1""")
add("q04_oee_metrics", lambda t: text(op.oee_metrics(t["equipment_metric"]), "measurement_date"), f"""
  select equipment_id, equipment_name, cast(measurement_date as varchar) as measurement_date, round(availability_rate * 100, 1) as availability_pct, round(performance_rate * 100, 1) as performance_pct,
    round(quality_rate * 100, 1) as quality_pct, round(oee_score * 100, 1) as oee_pct, downtime_hours from {{equipment_metric}} where {since('measurement_date', 7, 'equipment_metric')}""")
add("q04_downtime_by_category", lambda t: op.downtime_by_category(t["downtime_event"]), f"""
  select downtime_category, count(*) as event_count, sum(duration_minutes) as total_downtime_mins, round(avg(duration_minutes), 0) as avg_downtime_mins, sum(production_loss_units) as total_production_loss, {SUM.format('cost_impact')} as total_cost_impact
  from {{downtime_event}} where {since('event_date', 30, 'downtime_event')} group by 1""")
add("q04_failures", lambda t: op.failures(t["equipment"], t["failure_event"]), f"""
  select e.equipment_id, equipment_name, count(failure_id) as failure_count, round(sum(downtime_hours), 4) as total_downtime, round(avg(repair_cost), 4) as avg_repair_cost, round(avg(mtbf_impact), 4) as avg_mtbf_hours
  from {{equipment}} e left join {{failure_event}} f on f.equipment_id = e.equipment_id where {since('failure_date', 180, 'failure_event')} group by 1, 2 having count(failure_id) >= 1""")
add("q05_schedule_adherence", lambda t: text(op.schedule_adherence(t["production_schedule"]), "planned_start", "actual_start"), f"""
  select schedule_id, line_id, cast(planned_start as varchar) as planned_start, cast(actual_start as varchar) as actual_start, target_quantity, actual_quantity, round(actual_quantity / nullif(target_quantity, 0) * 100, 1) as completion_pct, efficiency_score
  from {{production_schedule}} where {since('planned_start', 7, 'production_schedule')}""")
add("q05_line_performance", lambda t: op.line_performance(t["production_line"], t["production_schedule"]), f"""
  select l.line_id, line_name, line_type, count(schedule_id) as scheduled_runs, sum(target_quantity) as total_target, sum(actual_quantity) as total_actual, round(avg(efficiency_score) * 100, 1) as avg_efficiency_pct
  from {{production_line}} l left join {{production_schedule}} s on s.line_id = l.line_id where {since('planned_start', 30, 'production_schedule')} group by 1, 2, 3""")
add("q06_quality_costs", lambda t: op.quality_costs(t["quality_cost"]), f"""
  select cost_category, cost_subcategory, {SUM.format('cost_amount')} as total_cost, sum(units_affected) as total_units, round(avg(cost_per_unit), 2) as avg_cost_per_unit, count(*) as incident_count
  from {{quality_cost}} where {since('cost_date', 30, 'quality_cost')} group by 1, 2""")
add("q07_defects_finance", lambda t: op.defects_for(t["defect_record"], "finance"), "select defect_id, severity_level, ncm_cost, cost_category, round(repair_cost + scrap_cost, 2) as total_cost_impact from {defect_record} where ncm_cost > 0")
add("q07_defects_customer", lambda t: text(op.defects_for(t["defect_record"], "customer"), "customer_notification_date"), "select defect_id, severity_level, customer_impact_flag, complaint_id, cast(customer_notification_date as varchar) as customer_notification_date from {defect_record} where customer_impact_flag = 1")
add("q07_defects_quality", lambda t: op.defects_for(t["defect_record"], "quality"), "select defect_id, severity_level, defect_type, root_cause, quality_score from {defect_record} where severity_level in ('Critical', 'Major', 'Minor')")
QUERIES, ORACLES = plans.queries, plans.oracles
