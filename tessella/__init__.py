"""Career-aware expert analytics and training-data preparation as DataFrame operators."""
