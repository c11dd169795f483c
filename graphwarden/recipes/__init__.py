"""Migration recipes (M12-M40): parameterised uses of the generic migrations and feed joins."""
