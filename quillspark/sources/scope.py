"""Which folders of an application count: a registry of modules, and where the application's root is."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, field

# The folders that a scan passes over, and the registry of the application that is scanned by default.
IGNORED = ("node_modules", "dist", "build", "out", ".git", ".next", ".nuxt", "coverage", ".vscode", ".idea")
SUFFIXES = (".ts", ".tsx")


@dataclass(frozen=True)
class Module:
    key: str
    relative_path: str
    description: str = ""


@dataclass(frozen=True)
class Scope:
    """``app_path``: where the application lies in a repository; ``marker``: the folder that an application's root has."""

    app_path: str = "apps/meteor"
    marker: str = ".meteor"
    modules: tuple[Module, ...] = field(
        default=(
            Module("lib-server-functions", "app/lib/server/functions", "Core server-side functions"),
            Module("authorization", "app/authorization", "Permissions and access control"),
            Module("e2e", "app/e2e", "End-to-end encryption"),
            Module("file-upload", "app/file-upload", "Uploads and media"),
        )
    )

    def resolve_root(self, root: str) -> str:
        """The application's root: ``root`` if it has the marker, else its application folder if there is one."""
        if os.path.exists(os.path.join(root, self.marker)):
            return root
        inner = os.path.join(root, self.app_path)
        return inner if os.path.exists(inner) else root

    def is_root(self, root: str) -> bool:
        return os.path.exists(os.path.join(self.resolve_root(root), self.marker))

    def warn_unless_root(self, root: str, variable: str = "SKIP_ROOT_CHECK") -> None:
        if not self.is_root(root) and not os.environ.get(variable):
            warnings.warn(f"{root} has no {self.marker}", stacklevel=2)

    def chosen(self, keys: list[str] | None = None) -> list[Module]:
        """Modules of these keys in the registry's order, all without keys. Unknown keys are passed over, but not alone."""
        found = [m for m in self.modules if not keys or m.key in keys]
        if not found:
            raise ValueError(f"no module has a key of {', '.join(keys or [])}")
        return found

    def folders(self, root: str, keys: list[str] | None = None) -> list[tuple[str, str]]:
        """(key, folder) of the chosen modules."""
        base = self.resolve_root(root)
        return [(m.key, os.path.join(base, m.relative_path)) for m in self.chosen(keys)]
