"""Names, codes and seeds that results depend on."""

# Classes in the order of the label vector's slots.
CLASSES = [
    "No Finding", "Atelectasis", "Cardiomegaly", "Consolidation", "Edema", "Pleural Effusion", "Pneumonia",
    "Pneumothorax", "Enlarged Cardiomediastinum", "Fracture", "Lung Lesion", "Lung Opacity",
]

# Classes of the balanced splits, in processing order.
SPLIT_CLASSES = ["Atelectasis", "Cardiomegaly", "Consolidation", "Edema", "No Finding", "Pleural Effusion", "Pneumonia", "Pneumothorax"]

# Substrings tested in concept names, in order.
LABELS = [
    "Atelectasis", "Cardiomegaly", "Consolidation", "Edema", "Effusion", "Pneumonia", "Pneumothorax", "Opacity",
    "Device", "Fracture", "Pleural", "Lesion",
]

# Label renames.
RENAMES = {
    "Pleural": "Pleural Other",
    "Device": "Support Devices",
    "Lesion": "Lung Lesion",
    "Opacity": "Lung Opacity",
    "Support Device": "Support Devices",
}

# Seed concept of each label.
LABEL_CONCEPTS = {
    "Atelectasis": ["C0004144"],
    "Cardiomegaly": ["C0018800"],
    "Enlarged Cardiomediastinum": ["C0018800"],
    "Consolidation": ["C0521530"],
    "Edema": ["C0013604"],
    "Pleural Effusion": ["C0032227"],
    "Pleural Other": ["C0348709"],
    "Pneumonia": ["C0032285"],
    "Pneumothorax": ["C0032326"],
    "Lung Opacity": ["C5921295"],
    "Support Devices": ["C0025080"],
    "Fracture": ["C0016658"],
    "Lung Lesion": ["C0577916"],
    "No Finding": [],
}

# Names that stand for a label when concept names are searched.
LABEL_NAMES = {"Pleural Effusion": "Effusion", "Lung Opacity": "Opacity"}

# Strength of assertions; anything else has 0.
PRECEDENCE = {"uncertain": 1, "present": 2, "absent": 3}

# Weights of semantic types; all others have 0.
TYPE_WEIGHTS = {"T047": 3, "T046": 2, "T033": 1}
ALLOWED_TYPES = {
    "Observation": ["T047", "T046", "T033", "T019", "T037"],
    "Anatomy": ["T017", "T023", "T029", "T030", "T082"],
}
PARENT_TYPES = ["T047", "T046", "T033"]
DEVICE_TYPE = "T074"

# Relation codes of the concept graph.
RELATIONS = ["SY", "CHD", "RQ", "RL", "PAR", "RB", "RN"]

# Words of the negation rule.
ABSENCE_WORDS = ["no", "not", "none", "without", "absent"]
UNCERTAIN_WORDS = ["maybe", "possible", "unclear", "could", "might", "suspect"]

# Rows per class of the test, retrieval and training splits.
TEST_ROWS, RETRIEVE_ROWS, TRAIN_ROWS = 198, 300, 700

# Ordinals that the undersampled split keeps of each class.
PICKS = {
    "Consolidation": [0, 1, 2, 3, 4, 5, 6, 7, 8, 11],
    "Atelectasis": [0, 1, 11, 3, 4, 5, 6, 7, 8, 9],
    "Cardiomegaly": [0, 1, 13, 3, 18, 19, 20, 7, 8, 21],
    "Edema": [0, 1, 2, 3, 4, 5, 10, 7, 8, 11],
    "No Finding": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    "Pleural Effusion": [0, 1, 2, 3, 4, 5, 11, 7, 8, 9],
    "Pneumonia": [0, 1, 2, 3, 4, 5, 6, 10, 8, 9],
    "Pneumothorax": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
}
