"""Column contracts: categories, ranges, models, and the herd defaults.

A contract is schema metadata. It lives on the driver and turns into column
expressions; no data passes through it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

INFERENCE = "INFERENCE_INPUT"
TRAINING = "TRAINING_DATASET"


class ContractError(ValueError):
    """A table or request breaks a column contract."""


@dataclass(frozen=True)
class FieldContract:
    """What one column may hold."""

    name: str
    kind: str  # "category" or "number"
    required: bool = False
    categories: tuple[str, ...] = ()
    value_map: Mapping[str, str] = field(default_factory=dict)
    minimum: float | None = None
    maximum: float | None = None
    nonnegative: bool = False
    percentage: bool = False
    warn_zero: bool = False
    hard_range_at_inference: bool = False


@dataclass(frozen=True)
class ModelContract:
    """The ordered inputs and the target of one model."""

    name: str
    features: tuple[str, ...]
    target: str
    derived: tuple[str, ...] = ()

    def __post_init__(self):
        repeated = sorted({f for f in self.features if self.features.count(f) > 1})
        if repeated:
            raise ContractError(f"{self.name} lists features twice: {', '.join(repeated)}")
        if self.target in self.features:
            raise ContractError(f"{self.name} uses its target {self.target!r} as an input")


@dataclass(frozen=True)
class TableContract:
    """All field and model contracts of a table."""

    fields: Mapping[str, FieldContract]
    models: Mapping[str, ModelContract]
    targets: tuple[str, ...]
    traceability: tuple[str, ...] = ()
    identifiers: tuple[str, ...] = ()
    exclusion_reasons: Mapping[str, str] = field(default_factory=dict)
    version: str = "1"

    def model(self, name: str) -> ModelContract:
        if name not in self.models:
            raise ContractError(f"unknown model {name!r}; known: {', '.join(sorted(self.models))}")
        chosen = self.models[name]
        unknown = [f for f in chosen.features if f not in self.fields]
        if unknown:
            raise ContractError(f"{name} uses fields without a contract: {', '.join(unknown)}")
        return chosen

    def with_field(self, item: FieldContract) -> TableContract:
        return replace(self, fields={**self.fields, item.name: item})


# The approved breeds.
BREEDS = (
    "Africander", "Ankole", "Australian_Friesian_Sahiwal", "Australian_Milking_Zebu", "Ayrshire",
    "Boran", "Brown_Swiss", "Butana", "Danish_Red", "Deoni", "Exotic_Local_Cross", "Fleckvieh",
    "Gangatiri", "Gir", "Girolando", "Guernsey", "Hariana", "Holstein-Friesian",
    "Holstein_Zebu_Cross", "Illawarra_Shorthorn", "Jersey", "Jersey_Zebu_Cross", "Kankrej",
    "Kenana", "Krishna_Valley", "Milking_Shorthorn", "Montbeliarde", "NDama", "Normande",
    "Norwegian_Red", "Ongole", "Rathi", "Red_Poll_Africa", "Red_Sindhi", "Sahiwal", "Simmental",
    "Tharparkar", "Tipo_Carora", "White_Fulani", "Zebu_Cross_Brazil",
)

# Breeds that point to dairy use, and those that do not.
DAIRY_BREEDS = (
    "Australian_Friesian_Sahiwal", "Australian_Milking_Zebu", "Ayrshire", "Brown_Swiss",
    "Danish_Red", "Girolando", "Guernsey", "Holstein-Friesian", "Holstein_Zebu_Cross",
    "Illawarra_Shorthorn", "Jersey", "Jersey_Zebu_Cross", "Milking_Shorthorn", "Montbeliarde",
    "Norwegian_Red", "Tipo_Carora",
)
OTHER_BREEDS = ("Africander", "Ankole", "Boran", "NDama", "Ongole", "White_Fulani")

# The approved feed labels and lactation stages.
FEED_TYPES = (
    "Concentrates", "Crop_Residues", "Dry_Fodder", "Green_Fodder", "Hay", "Mixed_Feed",
    "Pasture_Grass", "Silage",
)
LACTATION_STAGES = ("Early", "Mid", "Late")
LACTATION_MAP = {"Early Lactation": "Early", "Mid Lactation": "Mid", "Late Lactation": "Late"}

BASE_FEATURES = (
    "breed", "age_months", "weight_kg", "lactation_stage", "days_in_milk",
    "previous_week_avg_yield_l", "body_condition_score", "ambient_temperature_c",
    "humidity_percent",
)


def _herd_fields() -> dict[str, FieldContract]:
    category, number = "category", "number"
    listed = [
        FieldContract("breed", category, required=True, categories=BREEDS),
        FieldContract("age_months", number, True, minimum=1, maximum=300, nonnegative=True,
                      hard_range_at_inference=True),
        FieldContract("weight_kg", number, True, minimum=50, maximum=1200, nonnegative=True,
                      hard_range_at_inference=True),
        FieldContract("lactation_stage", category, True, LACTATION_STAGES, LACTATION_MAP),
        FieldContract("days_in_milk", number, minimum=0, maximum=730, nonnegative=True),
        FieldContract("previous_week_avg_yield_l", number, minimum=0, maximum=100, nonnegative=True),
        FieldContract("body_condition_score", number, minimum=1, maximum=5, nonnegative=True),
        FieldContract("ambient_temperature_c", number, minimum=-20, maximum=55),
        FieldContract("humidity_percent", number, minimum=0, maximum=100, percentage=True,
                      hard_range_at_inference=True),
        FieldContract("predicted_feed_type", category, True, FEED_TYPES),
        FieldContract("feed_type", category, categories=FEED_TYPES),
        FieldContract("feed_quantity_kg", number, nonnegative=True),
        FieldContract("milk_yield_l", number, nonnegative=True, warn_zero=True),
    ]
    return {f.name: f for f in listed}


HERD = TableContract(
    fields=_herd_fields(),
    models={
        m.name: m
        for m in (
            ModelContract("feed_type_classifier", BASE_FEATURES, "feed_type"),
            ModelContract("feed_quantity_regressor_design_a", BASE_FEATURES, "feed_quantity_kg"),
            ModelContract("feed_quantity_regressor_design_b", (*BASE_FEATURES, "predicted_feed_type"),
                          "feed_quantity_kg", derived=("predicted_feed_type",)),
            ModelContract("milk_yield_regressor", BASE_FEATURES, "milk_yield_l"),
        )
    },
    targets=("feed_type", "feed_quantity_kg", "milk_yield_l"),
    traceability=("animal_name", "animal_type", "cattle_id", "farm_id", "health_status",
                  "observation_date", "production_stage", "source_row_number"),
    identifiers=("cattle_id", "farm_id", "observation_date"),
    exclusion_reasons={
        "cattle_id": "IDENTIFIER_METADATA_ONLY",
        "farm_id": "IDENTIFIER_METADATA_ONLY",
        "observation_date": "DATE_METADATA_ONLY",
        "feed_type": "SAME_RECORD_TARGET_OR_OUTCOME",
        "feed_quantity_kg": "SAME_RECORD_TARGET_OR_OUTCOME",
        "milk_yield_l": "SAME_RECORD_TARGET_OR_OUTCOME",
        "disease_status": "SECONDARY_DATASET_OUTCOME",
        "production_stage": "DUPLICATES_LACTATION_STAGE",
        "health_status": "RULE_INPUT_ONLY",
    },
)

# Source names of every canonical column.
HERD_ALIASES: dict[str, tuple[str, ...]] = {
    "animal_type": ("species", "animalType", "type"),
    "animal_name": ("animalName", "name"),
    "breed": ("Breed", "breed"),
    "age_months": ("Age_Months", "ageMonths", "ageInMonths"),
    "weight_kg": ("Weight_kg", "weightKg", "weight"),
    "parity": ("Parity",),
    "health_status": ("healthStatus", "status", "condition", "recoveryStatus"),
    "lactation_stage": ("Lactation_Stage", "lactationStage"),
    "production_stage": ("productionStage",),
    "days_in_milk": ("Days_in_Milk", "daysInMilk"),
    "previous_week_avg_yield_l": ("Previous_Week_Avg_Yield", "previousWeekAvgYield"),
    "body_condition_score": ("Body_Condition_Score", "bodyConditionScore"),
    "ambient_temperature_c": ("Ambient_Temperature_C", "ambientTemperatureC"),
    "humidity_percent": ("Humidity_percent", "humidityPercent"),
    "season": ("Season",),
    "climate_zone": ("Climate_Zone",),
    "management_system": ("Management_System",),
    "feed_type": ("Feed_Type",),
    "feed_quantity_kg": ("Feed_Quantity_kg",),
    "milk_yield_l": ("Milk_Yield_L",),
    "cattle_id": ("Cattle_ID", "animalId", "tagId", "tagID"),
    "farm_id": ("Farm_ID",),
    "observation_date": ("Date", "date"),
    "disease_status": ("Disease_Status", "diseaseType"),
}
