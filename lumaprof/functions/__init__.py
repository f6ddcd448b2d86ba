"""Column expressions: metric values, addresses, classifiers, text and path rules."""
