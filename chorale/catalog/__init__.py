"""Every operator bound to the driver tables, with its SQL twin where SQL can say it."""
