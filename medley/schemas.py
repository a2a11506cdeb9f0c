"""Explicit schemas; ids stay strings even when they look numeric."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and order of the rating attributes.
RATINGS = [
    "Green", "Cucumber", "Herbal", "Mint", "Woody", "Pine", "Floral", "Powdery", "Fruity", "Citrus",
    "Tropical", "Berry", "Peach", "Sweet", "Caramellic", "Vanilla", "BrownSpice", "Smoky", "Burnt",
    "Roasted", "Grainy", "Meaty", "Nutty", "Fatty", "Coconut", "Waxy", "Dairy", "Buttery", "Cheesy",
    "Sour", "Fermented", "Sulfurous", "Garlic.Onion", "Earthy", "Mushroom", "Musty", "Ammonia", "Fishy",
    "Fecal", "Rotten.Decay", "Rubber", "Phenolic", "Animal", "Medicinal", "Cooling", "Sharp", "Chlorine",
    "Alcoholic", "Plastic", "Ozone", "Metallic",
]
# The two overall attributes, dims 0 and 1 of a label vector.
OVERALL = ["Intensity", "Pleasantness"]
# Attributes of the panel study.
PANEL_RATINGS = [
    "Acid", "Ammonia", "Bakery", "Burnt", "Chemical", "Cold", "Decayed", "Fish", "Flower", "Fruit",
    "Garlic", "Grass", "Musky", "Sour", "Spices", "Sweaty", "Sweet", "Warm", "Wood",
]
# Task flag columns.
TASKS = ["Task1", "Task2_single", "Task2_mix"]


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in kinds.items()])


COMPOUND = _fields(compound_id=T.IntegerType(), CID=T.LongType(), SMILES=T.StringType(), is_solvent=T.StringType())
RAW_COMPOUND = _fields(molecule=T.LongType(), SMILES=T.StringType(), is_solvent=T.StringType())
SINGLE_STIMULUS = _fields(
    stimulus=T.StringType(), molecule=T.LongType(), dilution=T.DoubleType(), solvent=T.StringType(),
    Intensity_label=T.StringType(),
)
COMPONENT = _fields(id=T.IntegerType(), molecule=T.LongType(), dilution=T.DoubleType(), solvent=T.StringType())
MIXTURE = _fields(id=T.StringType(), components=T.StringType())
SUBMISSION = T.StructType(
    [T.StructField("stimulus", T.StringType(), True), *[T.StructField(r, T.DoubleType(), True) for r in RATINGS]]
)
LABELS = T.StructType(
    [
        T.StructField("stimulus", T.StringType(), True),
        *[T.StructField(t, T.IntegerType(), True) for t in TASKS],
        *[T.StructField(r, T.DoubleType(), True) for r in OVERALL + RATINGS],
    ]
)
MIXTURE_COMPONENT = _fields(
    stimulus=T.StringType(), pos=T.IntegerType(), cid=T.LongType(), compound_id=T.IntegerType(),
    component=T.IntegerType(), dilution=T.DoubleType(), solvent=T.StringType(), solvent_id=T.IntegerType(),
    weakness=T.DoubleType(),
)
