"""The controlled vocabulary of predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values: (predicate, functional). Functional predicates hold one object at a time, the others any number.
PREDICATES = (
    ("works_at", True), ("version_is", True), ("runs_on", True), ("located_in", True), ("married_to", True), ("ceo_of", True), ("capital_of", True),
    ("published_on", True), ("born_on", True), ("died_on", True), ("height_is", True), ("weight_is", True), ("color_is", True), ("directed_by", True),
    ("released_on", True), ("headquartered_in", True), ("acquired_by", True), ("replaced_by", True), ("named", True), ("has_ip", True),
    ("runs_model", True), ("deployed_on", True), ("has_gpu", True), ("has_throughput", True), ("has_version", True), ("head_node_of", True),
    ("has_role", True), ("founded_in", True), ("located_at", True), ("has_port", True), ("has_regression", True), ("has_memory", True),
    ("has_timezone", True), ("has_profile", True), ("has_role_at", True), ("hosted_on", True), ("auth_method", True), ("author_of", False),
    ("uses", False), ("depends_on", False), ("related_to", False), ("employs", False), ("founded_by", False), ("member_of", False),
    ("parent_of", False), ("child_of", False), ("part_of", False), ("contains", False), ("manages", False), ("owns", False), ("created", False),
    ("manufactured_by", False), ("language_is", False), ("genre_is", False), ("starring", False), ("serves", False), ("competes_with", False),
    ("partnered_with", False), ("configured_with", False), ("part_of_cluster", False), ("connects_to", False), ("uses_framework", False),
    ("rejected", False), ("parent_brand_of", False), ("prefers", False), ("has_preference", False), ("builds", False), ("monitors", False),
    ("has_constraint", False), ("prohibited", False),
)
FUNCTIONAL = [p for p, functional in PREDICATES if functional]
PLURAL = [p for p, functional in PREDICATES if not functional]


def vocabulary(spark: SparkSession) -> DataFrame:
    """(predicate, functional): 70 rows, so it may be broadcast."""
    return spark.createDataFrame(PREDICATES, "predicate string, functional boolean")
