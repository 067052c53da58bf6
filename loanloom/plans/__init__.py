"""Multi-operator jobs: wide client table, preprocessing, training, scoring."""
