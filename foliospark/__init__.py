"""foliospark: document records, their data-quality rules, e-invoices and review, as Spark plans."""
