"""Scoring policy: weights, thresholds and vocabulary, changed by ``override`` only."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# The default policy that results must follow.
WEIGHTS = {
    "demolitionAtSameAddress": 20,
    "newResidentialConstruction": 30,
    "developmentAndBuildingPermit": 15,
    "newDwellingLanguage": 10,
    "twoOrMoreUnits": 10,
    "recognizedResidentialBuildingType": 10,
    "constructionValueAboveThreshold": 5,
    "renovationOnly": -25,
    "outsideCoreInfillArea": -40,
}
KEYWORDS = {
    "demolition": ["demolition", "demolish", "remove existing dwelling", "remove existing house"],
    "newConstruction": ["new building", "new construction", "construct", "construction of", "erect"],
    "newDwelling": ["new dwelling", "new house", "construct a dwelling", "construct dwelling", "construction of a dwelling"],
    "developmentPermit": ["development permit", "development application"],
    "buildingPermit": ["building permit"],
    "residentialBuilding": ["residential", "dwelling", "single detached", "detached house", "semi-detached", "semi detached", "duplex", "row house",
        "row housing", "townhouse", "town house", "garden suite", "garage suite", "backyard house", "backyard housing", "cluster housing",
        "multi-unit", "multi unit"],
    "renovation": ["addition", "alteration", "interior renovation", "renovation", "renovate", "repair"],
    "commercialOrIndustrial": ["commercial", "industrial", "office building", "restaurant", "retail", "warehouse"],
    "detached": ["single detached", "detached dwelling", "detached house", "new detached"],
    "semiDetached": ["semi-detached", "semi detached"],
    "duplex": ["duplex"],
    "rowHousing": ["row house", "row housing", "row dwelling", "townhouse", "town house"],
    "gardenSuite": ["garden suite", "garage suite", "backyard house", "backyard housing"],
    "propertyOnly": ["accessory building", "accessory structure", "detached garage", "mutual garage", "garage", "carport", "shed", "deck", "fence",
        "driveway", "air conditioner", "air conditioning", "hvac", "heating and ventilation", "solar panel", "hot tub", "swimming pool"],
    "inactiveStatus": ["cancelled", "canceled", "expired", "refused", "withdrawn", "void", "voided"],
}
CATEGORIES = [
    "PROBABLE_NEW_DETACHED_INFILL", "PROBABLE_NEW_DETACHED_INFILL_FOR_RESALE", "PROBABLE_SEMI_DETACHED_INFILL", "PROBABLE_DUPLEX", "PROBABLE_ROW_HOUSING", "PROBABLE_GARDEN_SUITE",
    "DEMOLITION_ONLY", "RENOVATION_OR_ADDITION", "UNCERTAIN_RESIDENTIAL_DEVELOPMENT", "NOT_RELEVANT",
]
STAGES = ["DISCOVERED", "DEMOLITION", "DEVELOPMENT_APPLICATION", "DEVELOPMENT_PERMIT", "BUILDING_PERMIT", "CONSTRUCTION", "INSPECTION", "COMPLETE", "CANCELLED"]
REVIEW_STATUSES = ["PENDING", "CONFIRMED", "CORRECTED", "NOT_RELEVANT", "MERGED"]
LABELS = {
    "PROBABLE_NEW_DETACHED_INFILL": "Probable new detached infill", "PROBABLE_NEW_DETACHED_INFILL_FOR_RESALE": "Probable new detached infill for resale",
    "PROBABLE_SEMI_DETACHED_INFILL": "Probable semi-detached infill", "PROBABLE_DUPLEX": "Probable duplex", "PROBABLE_ROW_HOUSING": "Probable row housing",
    "PROBABLE_GARDEN_SUITE": "Probable garden suite", "DEMOLITION_ONLY": "Demolition only", "RENOVATION_OR_ADDITION": "Renovation or addition",
    "UNCERTAIN_RESIDENTIAL_DEVELOPMENT": "Uncertain residential development", "NOT_RELEVANT": "Not relevant",
    "DISCOVERED": "Discovered", "DEMOLITION": "Demolition", "DEVELOPMENT_APPLICATION": "Development application", "DEVELOPMENT_PERMIT": "Development permit",
    "BUILDING_PERMIT": "Building permit", "CONSTRUCTION": "Construction", "INSPECTION": "Inspection", "COMPLETE": "Occupancy reported", "CANCELLED": "Cancelled",
    "PENDING": "Pending review", "CONFIRMED": "Confirmed", "CORRECTED": "Corrected", "MERGED": "Merged",
}
# end of the fixed values

PUBLIC_CATEGORIES = [c for c in CATEGORIES if c != "NOT_RELEVANT"]
START_CATEGORIES = [c for c in PUBLIC_CATEGORIES if c != "RENOVATION_OR_ADDITION"]


class ConfigError(ValueError):
    """A setting outside its bounds."""


@dataclass(frozen=True)
class ScoringConfig:
    weights: dict[str, int] = field(default_factory=lambda: dict(WEIGHTS))
    keywords: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in KEYWORDS.items()})
    high_value: float = 250_000
    window_days: int = 548
    gap_days: int = 548

    def override(self, weights: dict[str, int] | None = None, keywords: dict[str, list[str]] | None = None, high_value: float | None = None, gap_days: int | None = None, window_days: int | None = None) -> ScoringConfig:
        """A changed policy; a gap from the operator also sets the demolition window unless one is given."""
        if high_value is not None and not high_value >= 0:
            raise ConfigError("the value threshold must be a non-negative number")
        if gap_days is not None and (gap_days != int(gap_days) or not 1 <= gap_days <= 3650):
            raise ConfigError("the episode gap must be a whole number from 1 to 3650")
        gap = self.gap_days if gap_days is None else int(gap_days)
        window = window_days if window_days is not None else self.window_days if gap_days is None else gap
        return replace(self, weights=self.weights | (weights or {}), keywords=self.keywords | (keywords or {}), high_value=self.high_value if high_value is None else high_value, gap_days=gap, window_days=window)


DEFAULT = ScoringConfig()
