"""Operations on training text: filters, near-duplicates, mixing and formatting.

Each module holds one operator. `queries` applies them to the test tables.
"""
