"""Part of fieldspark."""
