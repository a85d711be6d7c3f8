"""Training-data operators: deduplication, language models, classifiers,
tokenising, decontamination and personal data, each as Spark jobs.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
