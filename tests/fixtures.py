"""The 80-row observation fixture, every category cycled."""

BREEDS = ("Jersey", "Gir", "Sahiwal", "Holstein-Friesian")
STAGES = ("Early", "Mid", "Late")
FEEDS = ("Concentrates", "Crop_Residues", "Dry_Fodder", "Green_Fodder", "Hay", "Mixed_Feed", "Pasture_Grass", "Silage")

SCHEMA = (
    "source_row_number bigint, cattle_id string, observation_date string, breed string, age_months string, weight_kg double, "
    "lactation_stage string, days_in_milk int, previous_week_avg_yield_l double, body_condition_score double, "
    "ambient_temperature_c double, humidity_percent double, feed_type string, feed_quantity_kg double, milk_yield_l double, "
    "health_status string, unapproved_extra string"
)


def observations(rows=80, **changes):
    """``changes`` maps a column to {row number: value}."""
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    out = []
    for i in range(rows):
        row = [
            i + 1, f"TEST_{i:04d}", "2024-01-01", BREEDS[i % 4], str(24 + i % 100), 300.0 + i, STAGES[i % 3], 1 + i % 364,
            float(i % 30), 2.0 + (i % 7) * 0.5, 20.0 + i % 15, 40.0 + i % 50, FEEDS[i % 8], 5 + (i % 20) * 0.5,
            2 + (i % 30) * 0.75, "Healthy", "x",
        ]
        for name, cells in changes.items():
            if i + 1 in cells:
                row[names.index(name)] = cells[i + 1]
        out.append(tuple(row))
    return out
