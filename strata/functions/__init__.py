"""Column functions over texts and addresses."""
