"""Multi-operator jobs: bootstrap analysis, batch annotation, corpus preparation and reports."""
