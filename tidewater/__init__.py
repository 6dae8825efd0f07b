"""A Spark-native engine for preference data: dialogues, mixing, templates, masks, losses and statistics."""
