"""The default ontology as tables; every operator takes other tables in its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Entity types, and the types that each kind of relation goes from and to.
ENTITY_TYPES = [
    "Weapon System", "Platform/Carrier", "Ammunition", "Electronic Equipment", "Combat Unit", "Command Structure", "Logistics Support",
    "Military Personnel", "Tactic/Method", "Campaign/Operation", "Military Facility", "Geographic Location", "Temporal Node", "Technical Specification",
]
RELATIONS = {
    "Equip-Carry": (["Platform/Carrier"], ["Weapon System", "Ammunition", "Electronic Equipment"]),
    "Equip-Counter": (["Weapon System", "Ammunition", "Electronic Equipment"], ["Weapon System", "Ammunition", "Electronic Equipment"]),
    "Equip-Develop": (["Weapon System", "Ammunition", "Electronic Equipment", "Platform/Carrier"], ["Combat Unit", "Command Structure", "Military Facility"]),
    "Unit-Org": (["Combat Unit"], ["Combat Unit", "Command Structure"]),
    "Unit-Equip": (["Combat Unit"], ["Weapon System", "Ammunition", "Electronic Equipment", "Platform/Carrier"]),
    "Person-Cmd": (["Military Personnel"], ["Combat Unit", "Command Structure", "Campaign/Operation"]),
    "Tactic-Apply": (["Tactic/Method"], ["Campaign/Operation", "Combat Unit", "Weapon System", "Platform/Carrier"]),
    "Tactic-Counter": (["Tactic/Method"], ["Tactic/Method", "Weapon System", "Platform/Carrier", "Combat Unit"]),
    "Campaign-Part": (["Campaign/Operation"], ["Combat Unit", "Command Structure", "Military Personnel", "Weapon System", "Platform/Carrier"]),
    "Weapon-Spec": (["Weapon System", "Ammunition", "Electronic Equipment", "Platform/Carrier"], ["Technical Specification"]),
    "Facility-Loc": (["Military Facility"], ["Geographic Location"]),
    "Causal-Lead": (["Campaign/Operation", "Tactic/Method", "Temporal Node"], ["Campaign/Operation", "Tactic/Method", "Temporal Node"]),
}
EQUIPMENT_TYPES = ["Weapon System", "Platform/Carrier", "Ammunition", "Electronic Equipment"]
# Attributes of equipment that become specifications.
SPECIFICATION_KEYS = [
    "caliber", "weight", "projectile_weight", "projectile", "mechanism", "ammunition_type", "effective_range", "range", "rate_of_fire", "capacity",
    "firing_rate", "velocity", "口径", "重量", "射程", "有效射程", "对空有效射程", "对地有效射程", "自动方式", "射击模式", "性能", "威力", "结构", "装填方式", "弹药类型",
]


def entity_types(spark: SparkSession) -> DataFrame:
    """type"""
    return spark.createDataFrame([(t,) for t in ENTITY_TYPES], "type string")


def relation_rules(spark: SparkSession) -> DataFrame:
    """kind, source_type, target_type: one row for each allowed combination."""
    rows = [(k, s, t) for k, (sources, targets) in RELATIONS.items() for s in sources for t in targets]
    return spark.createDataFrame(rows, "kind string, source_type string, target_type string")
