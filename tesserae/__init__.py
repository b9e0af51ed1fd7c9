"""Composable PySpark operators for turning raw public records into published, checked datasets."""
