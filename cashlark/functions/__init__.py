"""Column functions: text, money, time, payments and payload rules."""
