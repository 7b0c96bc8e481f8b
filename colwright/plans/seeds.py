"""The first feature of each known problem, as a spec over the problem's columns."""

from __future__ import annotations

from colwright.plans.spec import FeatureSpec, spec

# Feature name, operator and input columns per problem.
SEEDS: dict[str, FeatureSpec] = {
    "adult": spec("multiply", "age", "hours-per-week", name="age_hours_per_week"),
    "arrhythmia": spec("multiply", "QRSduration", "heartrate", name="qrs_heartrate_product"),
    "balance-scale": spec("absolute_difference", "Left-Weight", "Right-Weight", name="weight_difference"),
    "bank": spec("multiply", "balance", "duration", name="balance_duration"),
    "bike": spec("multiply", "hr", "mnth", name="hr_month"),
    "blood": spec("ratio", "Recency", "Time", name="Donation_Recency_Ratio"),
    "breast-w": spec(
        "mean", "Cell_Size_Uniformity", "Cell_Shape_Uniformity", "Clump_Thickness", name="structural_abnormality_index"
    ),
    "btc": spec("multiply", "close", "volume", name="price_volume"),
    "car": spec("mean", "maint", "safety", name="avg_maint_safety"),
    "cmc": spec("mean", "Wifes_education", "Husbands_education", name="Combined_Education_Index"),
    "communities": spec("multiply", "PctEmplManu", "HousVacant", name="PctEmplManu_HousVacant"),
    "covtype": spec(
        "subtract",
        "Horizontal_Distance_To_Roadways",
        "Horizontal_Distance_To_Fire_Points",
        name="distance_road_minus_fire",
    ),
    "crab": spec("value_count", "Weight", name="weight_counts"),
    "credit-g": spec("ratio_guarded", "duration", "age", name="duration_age_ratio"),
    "diabetes": spec("add", "PhysHlth", "MentHlth", name="Overall_Health_Limitations"),
    "eucalyptus": spec("subtract", "Crown_Fm", "Brnch_Fm", name="crown_branch_difference"),
    "forest-fires": spec("multiply", "temp", "RH", name="temp_RH"),
    "heart": spec("multiply", "RestingBP", "MaxHR", name="RestingBP_MaxHR"),
    "housing": spec("ratio", "population", "households", name="pop_per_household"),
    "insurance": spec("multiply", "age", "bmi", name="age_bmi"),
    "junglechess": spec("multiply", "white_piece0_file", "white_piece0_rank", name="piece_influence"),
    "myocardial": spec("multiply", "L_BLOOD", "ROE", name="L_BLOOD_ROE"),
    "pc1": spec("multiply", "D", "E", "V", scale=1e6, name="halstead_defect_potential"),
    "tic-tac-toe": spec(
        "recode",
        "middle-middle-square",
        mapping=(("x", "x"), ("o", "o")),
        default="b",
        name="Center_Occupation",
    ),
    "vehicle": spec("ratio", "COMPACTNESS", "CIRCULARITY", name="Compactness_to_Circularity_Ratio"),
    "wine": spec("subtract", "sulphates", "volatile acidity", name="sulphates_minus_volatile_acidity"),
}
