"""Column -> Column building blocks; nothing in here touches a DataFrame."""
